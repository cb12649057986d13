"""Shards of near equal bytes by histogram sort.

Rows are ordered by (crc32 of the text, doc_id), which keeps equal texts side by
side and lets a boundary fall inside a large group of them.  The driver
holds candidate key boundaries (probes) only.  Each round counts the exact
bytes between probes in one pass over a narrow table, and each splitter's
interval shrinks to the probe gap that holds its target; a splitter is done
when it is within the tolerance of its target or between two neighbouring
keys.  Rows are then exchanged once.

Shards are cut in ranges of at most ``range_bytes`` so that no task sorts a whole
shard: the window that numbers slots runs per range, with exact range offsets.

Defined cases: a null text has no bytes (size 8, crc32 0).  A null doc_id sorts
before all others.  Rows with equal text and doc_id are ties: they stay
together, in slots next to each other.  Shards may be empty when there
are fewer rows than shards.  Input columns pass through; new columns whose name is
taken get a leading underscore.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch, crc32_of, free_name, need

SHARDS = 24
OVERHEAD = 8                 # bytes that a row counts besides its text
TOLERANCE = 0.001            # of a shard's bytes
PROBES = 64                  # gaps that an interval is cut into per round
RANGE_BYTES = 256 << 20      # bytes of a range, the unit that one task sorts
MAX_RANGES = 4096            # bound of the splitter list
LOWEST = -(1 << 63)


@dataclass
class Open:
    """A splitter's interval of keys [low, high): on the crc, then on ids of one crc."""
    target: int
    below: int               # exact bytes of all keys before low
    crc: int | None          # set once the interval lies within one crc
    low: int
    high: int


def bounds_up_to(bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending (crc, id) bounds a row's key has reached, by binary search."""
    if not bounds:
        return F.lit(0)
    crcs = F.array(*(F.lit(c).cast("bigint") for c, _ in bounds))
    ids = F.array(*(F.lit(i).cast("bigint") for _, i in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def move(at: Column, step: Column) -> Column:
        to = F.least(at + step, F.lit(len(bounds)))
        crc, low = F.element_at(crcs, to), F.element_at(ids, to)
        reached = (F.col("crc") > crc) | ((F.col("crc") == crc) & (F.col("id") >= low))
        return F.when((at + step <= len(bounds)) & reached, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def interval_bounds(interval: tuple) -> tuple[tuple[int, int], tuple[int, int]]:
    """First key of an interval and first key behind it, as (crc, id)."""
    crc, low, high = interval
    if crc is None:
        return (low, LOWEST), (high, LOWEST)
    return (crc, low), ((crc, high) if high < -LOWEST else (crc + 1, LOWEST))


def gap_bytes(keys: DataFrame, intervals: list[tuple], probes: int) -> dict[tuple, list[tuple[int, int]]]:
    """Exact bytes per probe gap of each (disjoint) interval, from one pass: {interval: [(gap, bytes)]}."""
    intervals = sorted(intervals, key=interval_bounds)
    reached = bounds_up_to([b for i in intervals for b in interval_bounds(i)])
    at = F.floor((F.col("reached") + 1) / 2).cast("int")      # odd: inside the interval of this number
    by_crc = F.element_at(F.array(*(F.lit(i[0] is None) for i in intervals)), at)
    low = F.element_at(F.array(*(F.lit(i[1]).cast("decimal(20,0)") for i in intervals)), at)
    step = F.element_at(F.array(*(F.lit(width(i, probes)).cast("decimal(20,0)") for i in intervals)), at)
    value = F.when(by_crc, F.col("crc")).otherwise(F.col("id")).cast("decimal(20,0)")
    gaps = keys.select("crc", "id", "size", reached.alias("reached")) \
        .select("size", F.when(F.col("reached") % 2 == 1, F.struct(
            at.alias("i"), value.alias("v"), low.alias("lo"), step.alias("st"))).alias("g")).where("g is not null")
    counted = gaps.groupBy(F.col("g.i").alias("i"), F.expr("(g.v - g.lo) div g.st").alias("gap")) \
        .agg(F.sum("size").alias("b")).collect()                # at most ``probes`` rows per interval
    out: dict[tuple, list[tuple[int, int]]] = {i: [] for i in intervals}
    for r in sorted(counted):
        out[intervals[r.i - 1]].append((r.gap, r.b))
    return out


def width(interval: tuple, probes: int) -> int:
    return max(1, -(-(interval[2] - interval[1]) // probes))


def find_splitters(keys: DataFrame, parts: int, slack: float, probes: int = PROBES) -> list[tuple[int, int]]:
    """Keys (crc, id) that cut the rows into ``parts`` ranges of near equal bytes;
    each is within ``slack`` bytes of its target or next to the key that holds it."""
    total, low_id, high_id = keys.agg(F.sum("size"), F.min("id"), F.max("id")).first()
    if not total:
        return [(0, LOWEST)] * (parts - 1)
    done: dict[int, tuple[int, int]] = {}
    todo = {i: Open(total * i // parts, 0, None, 0, 1 << 32) for i in range(1, parts)}
    cuts = max(probes, 4 * parts)              # the first interval is shared by all splitters
    while todo:
        found = gap_bytes(keys, list({(o.crc, o.low, o.high) for o in todo.values()}), cuts)
        for i, o in list(todo.items()):
            iv = (o.crc, o.low, o.high)
            step, below = width(iv, cuts), o.below
            for gap, size in found[iv]:
                if below + size > o.target:
                    break
                below += size
            else:                              # the target lies at the interval's end
                gap, size = (o.high - o.low - 1) // step, 0
            low = o.low + gap * step
            high = min(o.high, low + step)
            if o.target - below <= slack or size == 0:
                done[i] = (low, LOWEST) if o.crc is None else (o.crc, low)
            elif below + size - o.target <= slack:
                done[i] = (high, LOWEST) if o.crc is None else (o.crc, high)
            elif high - low > 1:
                todo[i] = Open(o.target, below, o.crc, low, high)
                continue
            elif o.crc is None:                # one crc holds the target: go on inside, by id
                todo[i] = Open(o.target, below, low, low_id, high_id + 1)
                continue
            else:                              # one key holds it: the nearer side
                done[i] = (o.crc, low if 2 * (o.target - below) <= size else high)
            del todo[i]
        cuts = probes
    return [done[i] for i in range(1, parts)]


def assign_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES,
                  id_col: str = "doc_id", text: str = "text", probes: int = PROBES) -> DataFrame:
    """``docs`` with size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in
    each shard, in key order) and grown_shard (null: this law moves rows when shards are added)."""
    need(docs, id_col, text)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()),
                       (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
                       crc32_of(F.col(f"`{text}`")).alias("crc"),
                       F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOWEST)).alias("id"))
    with Scratch(docs.sparkSession, "shards") as scratch:
        keys = scratch.table(rows.select("id", "crc", "size"), "keys")
        total = keys.agg(F.sum("size")).first()[0] or 0
        per_shard = max(1, min(MAX_RANGES // shards, math.ceil(total / shards / range_bytes)))
        parts = shards * per_shard
        splitters = find_splitters(keys, parts, tolerance * total / shards, probes)

        part = bounds_up_to(splitters)
        counts = {r.p: r.n for r in keys.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}   # one row per range
    first, held = [], 0
    for p in range(parts):
        held = 0 if p % per_shard == 0 else held
        first.append(held)
        held += counts.get(p, 0)
    in_range = Window.partitionBy("p").orderBy("crc", "id", "size")
    slot = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in first)), F.col("p") + 1) + F.row_number().over(in_range) - 1
    new = {"size": F.col("size"), "text_crc32": F.col("crc"), "law": F.lit("bytes"),
           "shard": F.floor(F.col("p") / per_shard).cast("int"), "slot": slot, "grown_shard": F.lit(None).cast("int")}
    return rows.withColumn("p", part).select(
        *(F.col(n).alias(c) for c, n in names.items()), *(v.alias(free_name(docs, k)) for k, v in new.items()))


def shard_report(docs: DataFrame) -> DataFrame:
    """The digest of ``op4_histogram_shards``."""
    return assign_shards(docs.select("doc_id", "text")).drop("text")
