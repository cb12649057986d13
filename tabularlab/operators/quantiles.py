"""Exact grouped quantiles that stay distributed when one group or one value is huge.

Spark's ``percentile`` is exact but keeps, per group, a map of every distinct
value in one task.  Here rows are first counted per (group, value), which
combines on the map side, so a value that holds half of all rows is one counted
row.  The counted values are range-partitioned on (group, value), running
weights come from per-partition totals (one row per partition and group), and
only the partitions that hold a wanted order statistic are looked into.  The
two order statistics around ``1 + (n - 1) p`` are interpolated linearly (the
pandas / SQL ``quantile_cont`` rule).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.session import materialize


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per group: ``keys`` + ``q_<i>`` for each probability (double)."""
    keys = list(keys)
    counted = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()) \
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranged = materialize(counted.repartitionByRange(*[F.col(k) for k in keys], F.col("_v"))
                         .withColumn("_pid", F.spark_partition_id()), "quantiles")
    # one row per partition and group: small however many rows a group has
    seg = ranged.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_w"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_w").over(before), F.lit(0))).withColumn("_n", F.sum("_w").over(by_key))
    wanted = []
    for i, p in enumerate(probs):
        pos = F.lit(1.0) + (F.col("_n") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(2 * i + side).alias("i"), rank.cast("bigint").alias("rank"), (pos - F.floor(pos)).alias("frac"))
                   for side, rank in enumerate((F.floor(pos), F.ceil(pos)))]
    held = seg.withColumn("_ps", F.filter(F.array(*wanted), lambda x: (x["rank"] > F.col("_off"))
                                          & (x["rank"] <= F.col("_off") + F.col("_w")))) \
        .where(F.size("_ps") > 0).select(*keys, "_pid", "_off", "_ps")
    running = F.col("_off") + F.sum("_c").over(Window.partitionBy(*keys, "_pid").orderBy("_v"))
    # null-safe: rows without a key are a group like any other
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_hp"), "_off", "_ps")
    same = F.col("_pid") == F.col("_hp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = ranged.join(held, same).withColumn("_run", running).select(
        *keys, "_v", F.explode(F.filter("_ps", lambda x: (x["rank"] <= F.col("_run"))
                                        & (x["rank"] > F.col("_run") - F.col("_c")))).alias("_p"))
    picks = [F.max(F.when(F.col("_p.i") == k, F.col("_v"))).alias(f"_v{k}") for k in range(2 * len(probs))]
    fracs = [F.max(F.when(F.col("_p.i") == 2 * i, F.col("_p.frac"))).alias(f"_f{i}") for i in range(len(probs))]
    out = found.groupBy(*keys).agg(*picks, *fracs)
    return out.select(*keys, *[(F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) * F.col(f"_f{i}")).alias(f"q_{i}")
                               for i in range(len(probs))])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5]).withColumnRenamed("q_0", out)
