"""Aggregation operators (AG1-AG30).

Group aggregates rely on Spark's partial (map-side) aggregation, so a hot key
costs one partial row per map task.  Group totals needed per row are computed
with ``groupBy`` and joined back instead of a window over the group, which
would sort a whole hot group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularlab.operators.quantiles import exact_quantiles


def summary_stats(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """AG1: global mean / sample std / min / max, rounded."""
    return df.agg(F.round(F.avg(col), digits).alias("mean"), F.round(F.stddev_samp(col), digits).alias("std"),
                  F.min(col).alias("min"), F.max(col).alias("max"))


def value_counts(df: DataFrame, cols: Sequence[str] | str, top: int | None = None,
                 dropna: bool = True, digits: int = 6) -> DataFrame:
    """AG5: count per value (D2: null keys dropped by default), share of the
    total, optionally the top n by (count desc, value asc)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    src = df.dropna(subset=cols) if dropna else df
    counts = src.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
    total = src.agg(F.count(F.lit(1))).scalar()
    counts = counts.withColumn("share", F.round(F.col("count") / total, digits))
    if top is not None:
        counts = counts.orderBy(F.col("count").desc(), *[F.col(c).asc() for c in cols]).limit(top)
    return counts


def stacked_value_counts(df: DataFrame, cols: Sequence[str], value: str = "value") -> DataFrame:
    """AG6: value counts over several columns together (unpivot, then count)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "_column", value)
    return long.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count"))


def count_of_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG7: distribution of group sizes: (group_size, n_groups)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


def pivot_summary(df: DataFrame, index: str, value: str, digits: int = 6) -> DataFrame:
    """AG10: per index value: mean, count, sum, stacked back to (index, stat, value) rows."""
    g = df.groupBy(index).agg(F.round(F.avg(value), digits).alias("mean"),
                              F.count(value).cast("double").alias("count"),
                              F.sum(value).cast("double").alias("sum"))
    return g.unpivot([index], ["mean", "count", "sum"], "stat", "value")


def crosstab(df: DataFrame, row: str, col: str, values: Mapping[str, str] | None = None) -> DataFrame:
    """AG11: row x column counts; ``values`` maps pivot values to output names.  Without it the
    values are those that occur, named ``col_value``; more than ``distinct_values`` allows raise."""
    if values is None:
        from tabularlab.operators.reshape import distinct_values
        values = {v: f"{col}_{v}" for v in distinct_values(df, col)}
    p = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return p.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(name) for v, name in values.items()])


def describe_numeric(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """AG13: count, mean, std, min, 25/50/75 % (exact, interpolated) and max per column."""
    # the moments of all columns in one pass over the rows
    one = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in (
        ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                     F.round(F.col(f"{c}__mean"), digits).alias("mean"), F.round(F.col(f"{c}__std"), digits).alias("std"),
                     F.col(f"{c}__min").cast("double").alias("min"), F.col(f"{c}__max").cast("double").alias("max")) for c in cols]
    base = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "_x")
    q = exact_quantiles(long, ["column"], "_x", [0.25, 0.5, 0.75])
    return base.join(q, "column", "left").select("column", "count", "mean", "std", "min",
                                         F.round("q_0", digits).alias("p25"), F.round("q_1", digits).alias("p50"),
                                         F.round("q_2", digits).alias("p75"), "max")


def describe_categorical(df: DataFrame, col: str) -> DataFrame:
    """AG14: count, unique, top (most frequent, ties -> smallest value), freq."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    # min_by over (-count, value) picks the most frequent, smallest on ties
    return counts.agg(F.sum("_c").alias("count"), F.count(F.lit(1)).alias("unique"),
                      F.min_by(F.col(col), F.struct(-F.col("_c"), F.col(col))).alias("top"),
                      F.max("_c").alias("freq"))


def minmax_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG15: (column, min, max) from one aggregation."""
    one = df.agg(*[F.min(c).cast("double").alias(f"{c}__min") for c in cols],
                 *[F.max(c).cast("double").alias(f"{c}__max") for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
            for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def extreme_rows(df: DataFrame, value: str, tiebreak: str, cols: Sequence[str]) -> DataFrame:
    """AG16: the row with the largest and the one with the smallest value
    (ties -> smallest ``tiebreak``), tagged ``kind``; one aggregation."""
    payload = F.struct(*[F.col(c) for c in cols])
    r = df.agg(F.max_by(payload, F.struct(F.col(value), -F.col(tiebreak))).alias("largest"),
               F.min_by(payload, F.struct(F.col(value), F.col(tiebreak))).alias("smallest"))
    return r.select(F.explode(F.array(F.struct(F.lit("largest").alias("kind"), F.col("largest").alias("row")),
                                      F.struct(F.lit("smallest").alias("kind"), F.col("smallest").alias("row"))))
                    .alias("x")).select("x.kind", "x.row.*")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the rows that have both values: null without such rows, NaN if either value
    never varies (``corr`` divides by zero there, which ends the query under ANSI rules)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
    cov = F.covar_pop(x, y)
    return F.when(cov.isNotNull(), F.coalesce(F.try_divide(cov, spread), F.lit(float("nan"))))


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """AG17: pairwise-complete Pearson correlation for every pair a <= b, long form,
    all pairs computed in one aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                     F.round(F.col(f"{a}__{b}"), digits).alias("corr")) for a, b in pairs]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def strongest_pairs(corr_long: DataFrame) -> DataFrame:
    """AG19: strongest positive and strongest negative off-diagonal pair, in one aggregation.
    NaN is above every number, as in the order of both engines."""
    off = corr_long.where((F.col("col_a") < F.col("col_b")) & F.col("corr").isNotNull())
    row = F.struct("col_a", "col_b", "corr")
    one = off.agg(F.min_by(row, F.struct(~F.isnan("corr"), -F.col("corr"), F.col("col_a"), F.col("col_b"))).alias("positive"),
                  F.min_by(row, F.struct("corr", "col_a", "col_b")).alias("negative"))
    return one.select(F.explode(F.array(*[F.struct(F.col(k).alias("row"), F.lit(k).alias("kind"))
                                          for k in ("positive", "negative")])).alias("r")) \
        .where("r.row is not null").select("r.row.*", "r.kind")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """AG20: equal-width bins between min and max (max falls in the last bin):
    (bin, lo, hi, count).  min/max come from one small aggregation job and are
    inlined as literals, so the counting pass is a single scan."""
    mn, mx = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()   # two numbers to the driver
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    mn, mx = F.lit(float(mn)), F.lit(float(mx))
    width = (mx - mn) / bins
    b = F.least(F.floor((F.col(col) - mn) / width) + 1, F.lit(bins)).cast("int")
    counted = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (mn + (F.col("bin") - 1) * width).alias("lo"), (mn + F.col("bin") * width).alias("hi"),
                          "count")


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "share", digits: int = 6) -> DataFrame:
    """AG25: value / group total; the totals table is joined back (AQE decides
    broadcast vs shuffle from its measured size)."""
    tot = df.groupBy(*keys).agg(F.sum(value).alias("_tot"))
    return df.join(tot, list(keys)).withColumn(out, F.round(F.try_divide(F.col(value), F.col("_tot")), digits)).drop("_tot")


class SingleValueError(ValueError):
    pass


def assert_single_value(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """AG27: raise when a group has more than one distinct value of ``col``;
    returns (n_groups, max_distinct)."""
    g = df.groupBy(*keys).agg(F.countDistinct(col).alias("_nd"))
    summary = g.agg(F.count(F.lit(1)).alias("n_groups"), F.max("_nd").alias("max_distinct"))
    row = summary.first()
    if row["max_distinct"] is not None and row["max_distinct"] > 1:
        bad = g.where(F.col("_nd") > 1).limit(1).first()
        raise SingleValueError(f"group {[bad[k] for k in keys]} has {bad['_nd']} distinct values of {col}")
    return summary


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence, normalize: bool = False,
                     digits: int = 6) -> DataFrame:
    """AG29: label x prediction counts (explicit class list), optionally row-normalised."""
    names = {c: f"pred_{c}" for c in classes}
    p = df.groupBy(label).pivot(pred, list(classes)).agg(F.count(F.lit(1)))
    p = p.select(label, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for c, n in names.items()])
    if not normalize:
        return p
    tot = sum(F.col(n) for n in names.values())
    return p.select(label, *[F.round(F.col(n) / tot, digits).alias(n) for n in names.values()])


def conditional_count(df: DataFrame, cond: Column, name: str = "n_true", digits: int = 6) -> DataFrame:
    """AG22: count and share of rows satisfying a condition."""
    return df.agg(F.count_if(cond).alias(name), F.count(F.lit(1)).alias("n_rows"),
                  F.round(F.avg(cond.cast("double")), digits).alias("ratio"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """AG4: distinct values per column in one pass; ``approx`` uses HyperLogLog++
    sketches (constant memory per column, mergeable across tasks) instead of an
    exact distinct aggregation."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.countDistinct
    return df.agg(*[fn(c).alias(f"n_{c}") for c in cols])


SKETCH_BITS = 14         # 2**14 places: a relative error of about 0.65 %


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """AG4: one HyperLogLog sketch per group and column, to be stored; a sketch has a fixed size."""
    return df.groupBy(*by).agg(*(F.hll_sketch_agg(c, F.lit(bits)).alias(c) for c in cols))


def merged_distinct(sketches: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AG4: distinct counts over any groups of stored sketches, without the rows behind them."""
    return sketches.groupBy(*by).agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols))
