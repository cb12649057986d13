"""SimHash near-duplicates, linked through vantage-point trees.

A fingerprint has a bit set where more than half of the text's shingle hashes
have it.  Distinct fingerprints are cut into three bit segments: two that
differ in at most four bits differ in at most one bit of some segment.  For
each segment a vantage-point tree splits the codes by Hamming distance to one
vantage code per level (drawn from a bounded sample; any choice is exact).  A
fingerprint has one home shard; the triangle bound says which other shards
can hold a partner, and it also visits those whose boundary it overlaps:
|d(x, v) - d(y, v)| <= d(x, y), so a branch beyond the radius is pruned.  Each
shard compares its homes with all its rows over the full 64 bits, so links are
exact, and emits a spanning forest of them rather than all pairs.

Equal fingerprints meet before the tree (one aggregation), so copies cost
nothing there.  A shard above ``shard_rows`` rows is dealt as pairs of blocks,
which covers the same comparisons in bounded tasks.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and
links like any other.  A null doc_id keeps its row; ids of a component are
the smallest non-null doc_id in it (null if there is none).  Repeated rows
share fingerprint and component.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch, need
from tabularlab.llm.components import component_roots

SEED = 42
HASH_BLOCK = 1 << 16      # shingles hashed at a time
SEGMENTS = 3
SAMPLE_ROWS = 4096        # bound of the sample that vantage codes are drawn from
LEAF_HOMES = 1024         # homes a shard should have
SHARD_ROWS = 20_000       # rows above which a shard is dealt as pairs of blocks
CANDIDATES = 24           # vantage codes tried per level


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the text's ``width``-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < width:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(spans), HASH_BLOCK):
        part = b"".join([digest(joined[a:b], SEED) for a, b in spans[at: at + HASH_BLOCK]])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint's 64 bits as a signed long."""
    need(docs, id_col, text)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"),
                       F.col(text).alias("t"), F.lit(None).cast("bigint").alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["id", "text_hash", "fp"])

    return slim.mapInArrow(run, slim.select("id", "text_hash", "fp").schema)


def segment_codes(fps: np.ndarray, segment: int, segments: int) -> np.ndarray:
    edges = [64 * i // segments for i in range(segments + 1)]
    low, bits = edges[segment], edges[segment + 1] - edges[segment]
    return (fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def plan_levels(codes: np.ndarray, depth: int, radius: int) -> list[tuple[int, int]]:
    """(vantage code, boundary distance) per level, chosen on the sample to make
    the fewest comparisons; any choice gives the same links."""
    rng = np.random.default_rng(7)
    cell = np.zeros(len(codes), np.int64)
    levels: list[tuple[int, int]] = []
    for _ in range(depth):
        best = None
        for v in rng.choice(codes, min(CANDIDATES, len(codes)), replace=False):
            d = np.bitwise_count(codes ^ v).astype(np.int64)
            middle = int(np.median(d))
            for mu in (middle - 1, middle):
                left = np.bincount(cell[d <= mu], minlength=cell.max() + 1)
                right = np.bincount(cell[d > mu], minlength=cell.max() + 1)
                band = np.bincount(cell[(d > mu) & (d <= mu + radius)], minlength=cell.max() + 1)
                cost = int((left * (left + band) + right * right).sum())
                if best is None or cost < best[0]:
                    best = (cost, int(v), mu, d)
        _, v, mu, d = best
        levels.append((v, mu))
        _, cell = np.unique(cell * 2 + (d > mu), return_inverse=True)
    return levels


def route(codes: np.ndarray, levels: list[tuple[int, int]], radius: int):
    """(row, path, home) of every shard a code lives in or has to visit.

    A home goes to one side of each boundary.  From the far side it also visits
    the near side if within ``radius`` of the boundary, so that of two partners
    that a boundary parts, one meets the other exactly once; a visitor follows
    every branch its ball reaches."""
    row = np.arange(len(codes))
    path = np.zeros(len(codes), np.int64)
    home = np.ones(len(codes), bool)
    for v, mu in levels:
        d = np.bitwise_count(codes[row] ^ np.uint64(v)).astype(np.int64)
        near = d <= mu
        reach = d <= mu + radius
        left = np.where(home, near | reach, reach)
        right = np.where(home, ~near, d > mu - radius)
        row = np.concatenate([row[left], row[right]])
        path = np.concatenate([path[left] * 2, path[right] * 2 + 1])
        home = np.concatenate([(home & near)[left], home[right]])
    return row, path, home


def shard_links(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links of homes with homes and visitors."""
    rows = np.concatenate([homes, visitors])
    label = np.arange(len(rows))
    for a in range(0, len(homes), 256):
        block = homes[a: a + 256, None]
        for b in range(a, len(rows), 8192):
            i, j = np.nonzero(np.bitwise_count(block ^ rows[None, b: b + 8192]) <= max_bits)
            i, j = i + a, j + b
            linked = i < j
            i, j = i[linked], j[linked]
            while len(i):
                p, q = label[i], label[j]
                apart = p != q
                if not apart.any():
                    break
                i, j, p, q = i[apart], j[apart], p[apart], q[apart]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while not np.array_equal(label, after := label[label]):
                    label = after
    node = np.nonzero(label != np.arange(len(rows)))[0]
    return rows[node], rows[label[node]]


def fingerprint_links(nodes: DataFrame, scratch: Scratch, max_bits: int = 4, segments: int = SEGMENTS,
                      leaf_homes: int = LEAF_HOMES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints within ``max_bits`` of one another."""
    radius = max_bits // segments
    total = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / leaf_homes)))
    sample = nodes.sample(fraction=min(1.0, 1.2 * SAMPLE_ROWS / max(1, total)), seed=11).limit(SAMPLE_ROWS)
    drawn = np.array([r.fp for r in sample.collect()] or [0], np.int64).view(np.uint64)
    depth = min(depth, 64 // segments)
    trees = [plan_levels(segment_codes(drawn, s, segments), depth, radius) for s in range(segments)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at: at + 4096]
                for s, levels in enumerate(trees):
                    row, path, home = route(segment_codes(part, s, segments), levels, radius)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path * segments + s), pa.array(part[row].view(np.int64)), pa.array(home)],
                        names=["shard", "fp", "home"])

    dealt = scratch.table(nodes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean"), "dealt")
    large = scratch.table(dealt.groupBy("shard").count().where(F.col("count") > shard_rows)
                          .select("shard", F.ceil(2 * F.col("count") / shard_rows).cast("int").alias("blocks")), "large")
    # blocks of an over-full shard meet pairwise: (i, j) holds the rows of block i and block j
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    parts = dealt.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .select("shard", "fp", "home", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("shard", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp", "home")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        home = pdf["home"].to_numpy()
        u, v = shard_links(fps[home], fps[~home], max_bits)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return parts.groupBy("shard", "a", "b").applyInPandas(links, "u long, v long")


def grouped_fingerprints(docs: DataFrame, scratch: Scratch, width: int = 4, max_bits: int = 4,
                         id_col: str = "doc_id", text: str = "text", **tree) -> DataFrame:
    """(id, text_hash, fp, root, first_id) per row: root names the component, first_id is its smallest id."""
    rows = scratch.table(fingerprints(docs, width, id_col, text), "rows")
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    links = fingerprint_links(nodes, scratch, max_bits, **tree)
    roots = component_roots(links, scratch)
    member = scratch.table(nodes.join(roots, F.col("fp") == F.col("node"), "left")
                           .select("fp", "low", F.coalesce("root", "fp").alias("root")), "member")
    low = member.groupBy("root").agg(F.min("low").alias("first_id"))
    return rows.join(member.join(low, "root").select("fp", "root", "first_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text: str = "text", **tree) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``."""
    with Scratch(docs.sparkSession, "simhash") as scratch:
        grouped = grouped_fingerprints(docs, scratch, width, max_bits, id_col, text, **tree)
        return scratch.table(grouped.select(
            F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
            F.col("first_id").alias("component_id")), "result", keep=True)


def drop_near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                         text: str = "text", **tree) -> DataFrame:
    """One row of ``docs`` per component: the smallest (id, text hash), null ids last;
    of identical rows, one."""
    with Scratch(docs.sparkSession, "simhash") as scratch:
        grouped = grouped_fingerprints(docs, scratch, width, max_bits, id_col, text, **tree)
        first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")).alias("k")
        keep = scratch.table(grouped.groupBy("root").agg(first).select("k.id", "k.text_hash"), "keep", keep=True)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}   # input names cannot clash with the join's
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    kept = rows.join(keep, F.col(names[id_col]).eqNullSafe(F.col("id"))
                     & (F.xxhash64(names[text]) == F.col("text_hash")), "left_semi")
    # what is left of rows with equal id and text: one each
    one = kept.withColumn("h", F.xxhash64(names[text])).dropDuplicates([names[id_col], "h"])
    return one.select(*(F.col(n).alias(c) for c, n in names.items()))
