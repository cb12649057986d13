"""Global order without a single-partition window (H1), top-k and offsets.

``with_row_number`` numbers rows 1..n under a total order: range-partition on
the order, sort within partitions, count rows per partition (a table with one
row per partition, hence a bounded broadcast), turn the counts into offsets and
add the in-partition position.  The range-partitioned data is checkpointed to
the shared checkpoint folder so both uses of it see the same partitions (and a
lost executor recomputes from the checkpoint, not from a different sample).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.session import ensure_checkpoint_dir, materialize


def _cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_row_number(df: DataFrame, order: Sequence, out: str = "row_no",
                    num_partitions: int | None = None) -> DataFrame:
    """Append a global 1-based row number under ``order`` (must be a total order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _cols(order)
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "rownum")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a window over it is tiny
    offs = counts.withColumn("_off", F.coalesce(
        F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranged.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(out, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off"))


def contiguous_folds(df: DataFrame, order: Sequence, k: int, out: str = "fold") -> DataFrame:
    """SM5 / D10: contiguous k folds under ``order``; the first n % k folds are one
    row larger (same sizes as ``ntile(k)``), numbered 1..k."""
    numbered = with_row_number(df, order, "_r")
    n = numbered.agg(F.count(F.lit(1))).scalar()
    q = F.floor(n / k)
    rem = n - q * k
    r0 = F.col("_r") - 1
    big = rem * (q + 1)
    fold = F.when(r0 < big, F.floor(r0 / (q + 1))).otherwise(rem + F.floor((r0 - big) / q))
    return numbered.withColumn(out, (fold + 1).cast("int")).drop("_r")


def top_k(df: DataFrame, order: Sequence, k: int, offset: int = 0) -> DataFrame:
    """TK2/TK3/WN14: first k rows (after ``offset``) under a total order.

    Planned as TakeOrderedAndProject: each task keeps its own top k+offset,
    only those reach the final merge.
    """
    o = df.orderBy(*_cols(order))
    if offset:
        o = o.offset(offset)
    return o.limit(k)


def neighbour_values(df: DataFrame, keys: Sequence[str], order: Sequence, value: str,
                     prev: str = "prev_value", next_: str = "next_value") -> DataFrame:
    """lag/lead of ``value`` within groups without a per-group window.

    A window partitioned by ``keys`` sorts each group in one task - fatal when
    a group holds a large share of the rows.  Here rows get global numbers
    under (keys, order); a row's neighbours are the rows numbered one less /
    one more, attached by equi-joins on that unique number (no hot key), and
    kept only when they belong to the same group."""
    keys = list(keys)
    numbered = with_row_number(df, [*[F.col(k) for k in keys], *_cols(order)], "_rn")
    side = numbered.select(*[F.col(k).alias(f"_nk_{k}") for k in keys], F.col("_rn").alias("_nrn"),
                           F.col(value).alias("_nv"))
    same = [F.col(k).eqNullSafe(F.col(f"_nk_{k}")) for k in keys]

    def attach(base, offset, name):
        j = base.join(side, F.col("_nrn") == F.col("_rn") + offset, "left")
        cond = F.lit(True)
        for c in same:
            cond = cond & c
        return j.withColumn(name, F.when(cond, F.col("_nv"))).drop("_nrn", "_nv", *[f"_nk_{k}" for k in keys])

    return attach(attach(numbered, -1, prev), 1, next_).drop("_rn")


def folds_within_groups(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "fold") -> DataFrame:
    """Stratified contiguous folds: ``ntile(k)`` within each group under ``order``,
    from global row numbers and per-group (start, size) - no per-group window."""
    keys = list(keys)
    numbered = with_row_number(df, [*[F.col(kk) for kk in keys], *_cols(order)], "_rn")
    bounds = numbered.groupBy(*[F.col(kk).alias(f"_bk_{kk}") for kk in keys]) \
        .agg(F.min("_rn").alias("_start"), F.count(F.lit(1)).alias("_n"))
    cond = F.lit(True)
    for kk in keys:   # a null group is a group too (null-safe match)
        cond = cond & F.col(kk).eqNullSafe(F.col(f"_bk_{kk}"))
    j = numbered.join(bounds, cond).drop(*[f"_bk_{kk}" for kk in keys])
    n, r0 = F.col("_n"), F.col("_rn") - F.col("_start")
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    fold = F.when(r0 < big, F.floor(r0 / (q + 1))).otherwise(rem + F.floor((r0 - big) / F.greatest(q, F.lit(1))))
    return j.withColumn(out, (fold + 1).cast("int")).drop("_rn", "_start", "_n")
