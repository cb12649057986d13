"""Join operators (JN1-JN13).

No join here carries a broadcast hint unless the small side has a fixed size
(a mapping given as a parameter, the 25-row nation table); otherwise AQE
converts a sort-merge join to a broadcast join when the *measured* size of a
side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits
skewed partitions of the rest.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FIXED_ROWS = 10_000          # rows of a lookup that may be broadcast


class JoinValidationError(ValueError):
    pass


def join_with_suffixes(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                       suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """JN1: equi-join on same-named keys; other clashing columns get suffixes."""
    on = list(on)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    lsel = [F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns]
    return left.select(*lsel).join(right.select(*rsel), on=on, how=how)


def join_on(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
            how: str = "left", null_safe: bool = False) -> DataFrame:
    """JN2/JN3: join on differently named (multi-)keys.  ``null_safe`` matches
    null to null like pandas (D1); the default drops null keys like SQL."""
    conds = [(left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b])
             for a, b in zip(left_on, right_on)]
    return left.join(right, functools.reduce(lambda x, y: x & y, conds), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """JN4: join on every shared column name."""
    on = sorted(set(left.columns) & set(right.columns))
    if not on:
        raise ValueError("no shared columns")
    return left.join(right, on=on, how=how)


def fold_join(tables: Sequence[DataFrame], key: Sequence[str] | str, how: str = "left") -> DataFrame:
    """JN5: join a list of feature tables on the entity key."""
    keys = [key] if isinstance(key, str) else list(key)
    return functools.reduce(lambda a, b: a.join(b, on=keys, how=how), tables)


def assert_unique(df: DataFrame, keys: Sequence[str], side: str = "") -> None:
    """Raise if ``keys`` repeat in ``df``.  One aggregation job; at most one
    offending key reaches the driver."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        vals = {k: dup[0][k] for k in keys}
        raise JoinValidationError(f"duplicate key on the {side or 'checked'} side: {vals} "
                                  f"({dup[0]['count']} rows)")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                 validate: str = "many_to_one") -> DataFrame:
    """JN6: join after checking the declared cardinality (``one_to_one``,
    ``one_to_many``, ``many_to_one``, ``many_to_many``)."""
    on = list(on)
    lhs, rhs = validate.split("_to_")
    if lhs == "one":
        assert_unique(left, on, "left")
    if rhs == "one":
        assert_unique(right, on, "right")
    return left.join(right, on=on, how=how)


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence, right_order: Sequence,
                    how: str = "inner", position: str = "position") -> DataFrame:
    """JN7: align two frames by row position under explicit orders (H1 row numbers)."""
    from tabularlab.operators.order import with_row_number
    a = with_row_number(left, left_order, position)
    b = with_row_number(right, right_order, position)
    return a.join(b, on=position, how=how)


def unmatched(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """JN8: rows of ``left`` without a partner in ``right`` (left anti join)."""
    conds = [left[a] == right[b] for a, b in zip(left_on, right_on)]
    return left.join(right, functools.reduce(lambda x, y: x & y, conds), "left_anti")


def unmatched_ratio(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """JN8: (n_left, n_unmatched, ratio) in one job."""
    r = right.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(right_on)], F.lit(True).alias("_hit")).distinct()
    conds = [left[a] == r[f"_r{i}"] for i, a in enumerate(left_on)]
    j = left.join(r, functools.reduce(lambda x, y: x & y, conds), "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_hit").isNull()).alias("n_unmatched")) \
        .withColumn("unmatched_ratio", F.round(F.col("n_unmatched") / F.col("n_rows"), 6))


def enrich(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, fixed_size: bool = False) -> DataFrame:
    """JN10: attach lookup columns by key (left join).  ``fixed_size`` marks a
    lookup whose size does not grow with the data: it is broadcast if it has no more than
    ``FIXED_ROWS`` rows (counting stops there), and left to AQE otherwise."""
    small = fixed_size and lookup.limit(FIXED_ROWS + 1).count() <= FIXED_ROWS
    lk = F.broadcast(lookup) if small else lookup
    return df.join(lk, df[key] == lookup[lookup_key], "left")


def link_by_measurements(df: DataFrame, measure_cols: Sequence[str], id_col: str) -> DataFrame:
    """JN11: record linkage by equal measurements.  Instead of materialising
    every candidate pair, group by the measurement tuple: each group's min/max
    candidate id and distinct count tell whether the link is unique."""
    return df.groupBy(*measure_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(id_col).alias("n_ids"),
        F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"))


def link_tables(left: DataFrame, right: DataFrame, measure_cols: Sequence[str], name_col: str, id_col: str) -> DataFrame:
    """JN11 over two tables: candidates of ``right`` with a row's measurements, per name of
    ``left``.  Candidates are grouped by measurement before the join, so no pair is
    made: each measured row meets one row with its candidates' number and ends."""
    cols = list(measure_cols)
    found = right.groupBy(*cols).agg(F.countDistinct(id_col).alias("_n"), F.min(id_col).alias("_low"), F.max(id_col).alias("_high"))
    return left.select(*cols, F.col(name_col).alias("name")).join(found, cols).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_measured"), F.sum("_n").alias("n_links"), F.min("_low").alias("min_id"), F.max("_high").alias("max_id"))
