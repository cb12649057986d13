"""Mixing sources to target weights by Poisson replication.

A source with n_s rows and target share w_s gets the mean repetition rate
T w_s / n_s, for T rows in all.  Each document's number of copies inverts the
Poisson distribution of that mean at a number hashed from the seed and its
id, so it depends on nothing else and is the same in every run.  Documents are
exploded by their counts and all copies are dealt anew by a hashed key.

Rates above ``MEAN`` are split in equal parts whose counts add up (a sum of
Poisson counts is Poisson), so the distribution table stays short.  The only
table joined to the documents has one row per source; Spark broadcasts it
when its written size is below its threshold and otherwise shuffles and splits
hot sources.

Defined cases: a null source is a source of its own.  A null doc_id hashes like
an empty one.  Repeated rows get equal counts.  A source without a given
weight has weight 0 and no copies.  An empty table gives an empty one.  Input
columns pass through; names that clash with a new column keep theirs and the
new one gets a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch, free_name, let, need

SEED = 20
MEAN = 32.0        # largest mean inverted at once
LAST = 160         # the distribution function reaches 1 before this count for means up to MEAN


def source_rates(docs: DataFrame, weights: dict | None = None, total: float | None = None,
                 source: str = "source") -> DataFrame:
    """(source, n, rate): mean repetitions per source.  Without ``weights`` the target
    share is in proportion to the square root of the source's rows; ``total``
    defaults to the number of rows."""
    need(docs, source)
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        table = F.create_map(*(F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1])))) if weights else None
        weight = F.coalesce(table[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("w", weight)
    sums = sizes.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))      # one row
    want = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    rate = F.when(F.col("all_w") > 0, want * (F.col("w") / F.col("all_w")) / F.col("n")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds ``parts`` and ``cdf``: the distribution function of one part, up to where it stops growing."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN)).cast("int")
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-mean)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(LAST)), F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"),
                                F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
        lambda acc: acc["c"])
    return rates.withColumn("parts", parts).withColumn("cdf", grown) \
        .withColumn("cdf", F.filter("cdf", lambda c: c < F.element_at(F.col("cdf"), -1)))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: dict | None = None, total: float | None = None, seed: int = SEED,
                id_col: str = "doc_id", source: str = "source", with_keys: bool = True) -> DataFrame:
    """The copies of all documents, globally shuffled: the columns of ``docs`` and, if
    ``with_keys``, ``copy`` (1, 2, ...) and ``shuffle_key`` (the order within a partition)."""
    need(docs, id_col, source)
    with Scratch(docs.sparkSession, "mix") as scratch:
        # one row per source, written so that the join knows its size
        table = scratch.table(poisson_table(source_rates(docs, weights, total, source)).select(
            F.col("source").alias("_s"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf")), "rates", keep=True)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    key = F.coalesce(F.col(names[id_col]).cast("string"), F.lit(""))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0),
        lambda acc, j: acc + let(unit(F.lit(str(seed)), key, j.cast("string")),
                                 lambda u: F.size(F.filter("_cdf", lambda c: c <= u))))
    copies = rows.join(table, F.col(names[source]).eqNullSafe(F.col("_s"))) \
        .withColumn("_n", count).where("_n > 0") \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("_copy").cast("string")).cast("binary")), 1, 16)
    # rebalanced by the hashed key: Spark may split a partition that one repeated id fills
    dealt = copies.withColumn("_key", order).hint("rebalance", "_key").sortWithinPartitions("_key")
    new = [F.col("_copy").alias(free_name(docs, "copy")), F.col("_key").alias(free_name(docs, "shuffle_key"))]
    return dealt.select(*(F.col(n).alias(c) for c, n in names.items()), *(new if with_keys else []))


MIX_SQL = f"""
with recursive s as (select source, count(*) as n, sqrt(cast(count(*) as double)) as w from documents group by source),
r as (select source, cast((select sum(n) from s) as double) * (w / (select sum(w) from s)) / n as rate from s),
m as (select source, greatest(1, cast(ceil(rate / {MEAN}) as int)) as parts,
             rate / greatest(1, cast(ceil(rate / {MEAN}) as int)) as mean from r),
t as (select source, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from m
      union all select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from t where k < {LAST}),
cdf as (select source, c from t qualify c < max(c) over (partition by source)),
d as (select doc_id, text, lang, documents.source, n_chars, j,
             cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || j), 1, 13)) as bigint)
                 / 4503599627370496.0 as u
      from documents join m on documents.source is not distinct from m.source, unnest(range(1, m.parts + 1)) as x(j)),
n as (select doc_id, text, lang, d.source, n_chars, count(cdf.c) as n
      from d left join cdf on d.source is not distinct from cdf.source and cdf.c <= d.u group by all)
select doc_id, text, lang, source, n_chars, cast(i as int) as copy,
       substr(md5('order{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || i), 1, 16) as shuffle_key
from n, unnest(range(1, n + 1)) as y(i)
"""
