"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle is five words in a row (fewer words: the whole sequence), hashed with
XXH64 over its words.  A sketch holds every distinct hash below a fixed fraction of
the hash space, so sketches of any texts can be merged by union, and the share
of one sketch that another holds estimates how much of the one text the other contains,
however unequal their lengths.  A text with words but no hash below the limit keeps its
smallest one, so that only texts without words have an empty sketch; such a
hash lies above the limit and takes no part in merged sketches.

All expressions are Spark's own.  Neighbours in id order come from one exchange: the
first key of every range of a narrow range-partitioned table cuts the rows into buckets, a row
that starts a bucket is also sent behind the bucket before it, and each bucket is one
window.  Nothing but those first keys (one per ``BUCKET_BYTES`` of text) is held by the driver.

Defined cases: a null text is the empty text, with no words and an empty fingerprint; two empty
fingerprints are alike (1), an empty and another one are not (0).  A null doc_id stands below
all others; rows with equal ids follow by the MD5 of their text, and rows equal in both, which
share a bucket, have each other as neighbours.  A single document is its own neighbour.  An empty table gives an
empty one.  ``sketch_documents`` passes other columns through and puts underscores before a
new name that is taken; the report reads id and text only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.llm.common import SPACE_CLASS, free_name, let, need

WIDTH = 5
FRACTION = 1 / 8
BUCKET_BYTES = 256 << 20
LOWEST = -(1 << 63)


def limit_of(fraction: float) -> int:
    """Hashes from 0 up to this one, exclusive, are the lowest ``fraction`` of the unsigned hashes."""
    if not 0 < fraction <= 0.5:
        raise ValueError("fraction must be above 0 and at most 1/2")
    return int(fraction * 2 ** 64)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles, repeats included."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")
    # a place behind the last word is null, which the hash passes over
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
        lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))))


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes below the limit, or else the smallest hash."""
    top = limit_of(fraction)
    low = F.lit(LOWEST)

    def retained(hashes: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: (h >= 0) & (h < F.lit(top)))))
        least = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(low))).bitwiseXOR(low)
        return let(kept, lambda k: F.when((F.size(k) > 0) | (F.size(hashes) == 0), k).otherwise(F.array(least)))

    return let(shingle_hashes(text, width), retained)


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash, ascending."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: shared hashes of all hashes."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0)
               .otherwise(both / (F.size(a) + F.size(b) - both)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's text that b contains (1 where a is empty)."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def sketch_documents(docs: DataFrame, text: str = "text", width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """``docs`` with ``sketch`` (array of longs)."""
    need(docs, text)
    return docs.withColumn(free_name(docs, "sketch"), sketch(F.col(f"`{text}`"), width, fraction))


def merged_sketches(sketched: DataFrame, by: str, hashes: str = "sketch", fraction: float = FRACTION) -> DataFrame:
    """The merged sketch of each group, as rows (by, hash): no group is held in one task."""
    rows = sketched.select(F.col(f"`{by}`").alias("group"), F.explode(F.col(f"`{hashes}`")).alias("hash"))
    return rows.where((F.col("hash") >= 0) & (F.col("hash") < F.lit(limit_of(fraction)))).distinct()


def contained_share(small: DataFrame, large: DataFrame) -> DataFrame:
    """(group, n, share): of each merged sketch in ``small``, the share of hashes that occur in ``large``."""
    known = large.select(F.col("hash").alias("h")).distinct()
    return small.join(known, F.col("hash") == F.col("h"), "left").groupBy("group").agg(
        F.count("*").alias("n"), F.avg(F.col("h").isNotNull().cast("int")).alias("share"))


def with_next(rows: DataFrame, values: list[str], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` (o, key, size and others) with ``next_<value>``: the values of the row behind it
    in order of (o, key); behind the last stands the first."""
    spark = rows.sparkSession
    keys = rows.select("o", "key", "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / bucket_bytes))
    first = keys.repartitionByRange(parts, "o", "key").groupBy(F.spark_partition_id().alias("p")) \
        .agg(F.min(F.struct("o", "key")).alias("k")).select("k.*")
    cuts = sorted(tuple(r) for r in first.collect())                     # one key per bucket
    table = spark.createDataFrame([([c[0] for c in cuts], [c[1] for c in cuts])], "cut_o array<bigint>, cut_key array<string>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))))

    def move(at: Column, by: Column) -> Column:
        o, key = F.get("cut_o", at + by - 1), F.get("cut_key", at + by - 1)
        return F.when((o < F.col("o")) | ((o == F.col("o")) & (key <= F.col("key"))), at + by).otherwise(at)

    at = F.aggregate(steps, F.lit(0), move) - 1                          # the last cut at or before the row
    starts = (F.get("cut_o", F.col("bucket")) == F.col("o")) & (F.get("cut_key", F.col("bucket")) == F.col("key"))
    before = F.pmod(F.col("bucket") - 1, F.lit(max(1, len(cuts))))
    here = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    sent = F.when(starts, F.array(here, F.struct(before.alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(here))
    dealt = rows.crossJoin(F.broadcast(table)).withColumn("bucket", at) \
        .select(*rows.columns, F.explode(sent).alias("at")).select(*rows.columns, "at.b", "at.guest")
    order = Window.partitionBy("b").orderBy("guest", "o", "key")
    return dealt.select("guest", *rows.columns, *(F.lead(v).over(order).alias(f"next_{v}") for v in values)) \
        .where("guest = 0").drop("guest")


def edited_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                  fraction: float = FRACTION, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The digest of ``op13_document_fingerprints``: each document against itself with its second
    half taken from the next one (by descending id), and against the next one."""
    need(docs, id_col, text)
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), said.alias("text")).select(
        "id", "text", F.bitwise_not(F.coalesce(F.col("id").cast("bigint"), F.lit(LOWEST))).alias("o"),
        F.md5(F.col("text").cast("binary")).alias("key"), (F.octet_length("text") + 8).cast("bigint").alias("size"),
        sketch(F.col("text"), width, fraction).alias("sketch"))
    paired = with_next(rows, ["text", "sketch"], bucket_bytes)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = paired.select("id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    sketched = edited.select("*", sketch(F.col("edited"), width, fraction).alias("edited_sketch"))
    return sketched.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"))
