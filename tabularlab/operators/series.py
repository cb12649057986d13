"""Window and time-series operators (WN1-WN16, AG26, RS4).

Windows are always partitioned by a series key and ordered by an explicit time
column; nothing here uses an unpartitioned window.  Series here are aggregated
facts (one row per series and period), so a window partition holds at most one
row per period.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def densify(facts: DataFrame, series: DataFrame, keys: Sequence[str], time_col: str,
            start, stop, fill: Mapping[str, object] | None = None) -> DataFrame:
    """WN15: one row per series and time step in [start, stop]; absent rows filled.

    ``series`` holds the series keys (one row per series); ``start``/``stop`` are
    ints or columns of ``series`` (per-series ranges).  The spine is generated
    per series with ``explode(sequence)`` - no cross join - and joined to the
    facts on (keys, time).
    """
    keys = list(keys)
    tt = facts.schema[time_col].dataType       # spine steps get the facts' type
    # The series list is small but fans out (x periods, then x levels downstream):
    # spread it over an explicit number of partitions, which AQE keeps, instead of
    # letting a tiny shuffle be coalesced into one task that then does all the work.
    # The number is the shuffle-partition setting, which is chosen by the data's size.
    series = series.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    spine = series.select(*keys, F.explode(F.sequence(_as_col(start).cast(tt), _as_col(stop).cast(tt))).alias(time_col))
    out = spine.join(facts, on=[*keys, time_col], how="left")
    if fill:
        for k, v in fill.items():
            out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v).cast(facts.schema[k].dataType)))
    return out


def first_difference(df: DataFrame, keys: Sequence[str], order: str, value: str,
                     out: str = "diff", lag: int = 1) -> DataFrame:
    """WN2: value - value lag(n) within each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value, lag).over(w))


def successive_difference_sums(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """AG26: per series, sum of squared and of absolute successive differences, and n."""
    d = first_difference(df, keys, order, value, "_d")
    return d.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("sum_sq_diff"),
        F.sum(F.abs("_d")).alias("sum_abs_diff"),
        F.count(value).alias("n"))


def rows_at_group_extreme(df: DataFrame, keys: Sequence[str], value: str, kind: str = "max") -> DataFrame:
    """WN3: rows whose value equals the group max (or min); ties are all kept.

    Computed as group extreme + join back rather than a window, so a hot group
    is reduced by partial aggregation instead of being sorted in one task.
    """
    agg = F.max(value) if kind == "max" else F.min(value)
    ext = df.groupBy(*keys).agg(agg.alias("_ext"))
    return df.join(ext, on=list(keys)).where(F.col(value) == F.col("_ext")).drop("_ext")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank_col: str | None = None) -> DataFrame:
    """WN4 / SM3: first n rows per group under ``order`` (which must be a total order).

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task forwards at most n rows per group: a group holding
    a third of the data costs no more shuffle than any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def group_broadcast(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """WN5 / JN12: attach group aggregates to every row (aggregate + join back)."""
    g = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return df.join(g, on=list(keys), how="left")


def launch_and_zero_periods(df: DataFrame, keys: Sequence[str], period: str, units: str) -> DataFrame:
    """WN6: per series, first period with units > 0 and the count of later zero periods.

    Input must be dense (one row per series and consecutive period).  Then the
    periods after launch number last - launch, of which n_positive - 1 had
    sales, so one aggregation answers both - no join back of the launch period.
    """
    launch = F.min(F.when(F.col(units) > 0, F.col(period)))
    n_pos = F.count_if(F.col(units) > 0)
    zero_after = F.coalesce((F.max(period) - launch) - (n_pos - 1), F.lit(0)).cast("bigint")
    return df.groupBy(*keys).agg(launch.alias("launch_period"), zero_after.alias("zero_periods_after_launch"))


def on_off_changes(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """WN8: indicator = clip(coalesce(value, 0), 0, 1); per series the net change
    (sum of differences, telescopes to last - first) and flips (sum of |differences|)."""
    ind = F.least(F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_ind", ind).withColumn("_d", F.col("_ind") - F.lag("_ind").over(w))
    return d.groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("net_change"),
                                F.coalesce(F.sum(F.abs("_d")), F.lit(0.0)).alias("flips"))


def relative_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """WN9: col - min(col) over the whole frame, as a scalar subquery
    (never an unpartitioned window)."""
    return df.withColumn(out, F.col(col) - df.agg(F.min(col)).scalar())


def step_distribution(dates: DataFrame, date_col: str) -> DataFrame:
    """WN10: distribution of the step (days) between consecutive distinct dates.

    The distinct dates are one row per calendar day, so their number is bounded
    by the covered time span, not by the data volume.
    """
    d = dates.select(F.to_date(date_col).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    w = Window.orderBy("_d")
    steps = d.withColumn("step_days", F.datediff("_d", F.lag("_d").over(w)).cast("bigint")) \
        .where(F.col("step_days").isNotNull())
    return steps.groupBy("step_days").agg(F.count(F.lit(1)).alias("n"))


def naive_forecast(df: DataFrame, keys: Sequence[str], period: str, value: str,
                   last_train: int, horizon: int) -> DataFrame:
    """WN11: the last ``horizon`` train periods of each series become the next ``horizon``."""
    return df.where((F.col(period) > last_train - horizon) & (F.col(period) <= last_train)) \
        .select(*keys, (F.col(period) + horizon).alias(period), F.col(value))


def lifetime_averages(df: DataFrame, keys: Sequence[str], day: str, units: str) -> DataFrame:
    """WN13: days = max - min + 1, daily = sum/days, monthly = 30 x daily."""
    g = df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                              F.sum(units).alias("total"))
    days = F.col("last_day") - F.col("first_day") + 1
    return g.withColumn("days", days) \
        .withColumn("daily_avg", F.col("total") / F.col("days")) \
        .withColumn("monthly_avg", F.col("daily_avg") * 30)
