"""Hierarchical roll-ups (AG8, AG9).

A hierarchy is a mapping ``level -> key list``.  All levels are computed in one
``GROUPING SETS`` aggregation: Spark expands each input row once per level and
partially aggregates in the same stage, so the shuffle carries at most one row
per (map task, group) whatever the number of levels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The twelve aggregation levels of the retail sales hierarchy,
# level number -> grouping keys (level 12 is the leaf series).
SALES_LEVELS: dict[int, list[str]] = {
    1: [],
    2: ["state_id"],
    3: ["store_id"],
    4: ["cat_id"],
    5: ["dept_id"],
    6: ["state_id", "cat_id"],
    7: ["state_id", "dept_id"],
    8: ["store_id", "cat_id"],
    9: ["store_id", "dept_id"],
    10: ["item_id"],
    11: ["item_id", "state_id"],
    12: ["item_id", "store_id"],
}


def _level_keys(levels: Mapping[int, Sequence[str]]) -> list[str]:
    keys: list[str] = []
    for cols in levels.values():
        for c in cols:
            if c not in keys:
                keys.append(c)
    return keys


def level_aggregate(df: DataFrame, levels: Mapping[int, Sequence[str]],
                    aggs: Sequence[Column], by: Sequence[str] = (),
                    level_col: str = "level", id_col: str = "id") -> DataFrame:
    """Aggregate ``df`` at every level of ``levels`` in a single pass.

    Output columns: ``level`` (int), ``id`` (``"level:key1:key2"``), ``by``
    columns, the key columns (null where not part of the level) and ``aggs``.
    """
    keys = _level_keys(levels)
    by = list(by)
    sets = [[*by, *cols] for cols in levels.values()]
    grouped = df.groupingSets(sets, *by, *keys).agg(
        *aggs, F.grouping_id().alias("_gid"))
    # grouping_id() covers every grouping column (by + keys, in that order) and
    # sets bit (n-1-i) for column i when it is NOT grouped; ``by`` is always grouped.
    allcols = [*by, *keys]
    n = len(allcols)
    gid_to_level = {}
    for level, cols in levels.items():
        gid = sum(1 << (n - 1 - i) for i, k in enumerate(allcols) if k not in cols and k not in by)
        gid_to_level[gid] = level
    level_expr = None
    id_expr = None
    for gid, level in gid_to_level.items():
        cols = levels[level]
        ident = F.concat_ws(":", F.lit(str(level)), *[F.col(c) for c in cols])
        if level_expr is None:
            level_expr = F.when(F.col("_gid") == gid, F.lit(level))
            id_expr = F.when(F.col("_gid") == gid, ident)
        else:
            level_expr = level_expr.when(F.col("_gid") == gid, F.lit(level))
            id_expr = id_expr.when(F.col("_gid") == gid, ident)
    out = grouped.withColumn(level_col, level_expr).withColumn(id_col, id_expr).drop("_gid")
    return out.select(level_col, id_col, *by, *keys, *[c for c in out.columns
                                                      if c not in (level_col, id_col, *by, *keys)])


def level_sums(df: DataFrame, levels: Mapping[int, Sequence[str]], measures: Sequence[str], by: Sequence[str] = (),
               split: str = "item_id") -> DataFrame:
    """(level, id, by, measures): sums at every level, in two steps.

    The levels that use the finest key (``split``) read the leaf table; all others
    read its sums over the other keys, which are far fewer rows, so most levels
    are expanded from a small table."""
    from tabularlab.session import materialize
    keys, by = _level_keys(levels), list(by)
    fine = {k: v for k, v in levels.items() if split in v}
    if not fine or len(fine) == len(levels):
        return level_aggregate(df, levels, [F.sum(m).alias(m) for m in measures], by).select("level", "id", *by, *measures)
    sums = [F.sum(m).alias(m) for m in measures]
    leaf = materialize(df.groupBy(*by, *keys).agg(*sums), "leaf")
    rest = leaf.groupBy(*by, *[k for k in keys if k != split]).agg(*sums)
    low = level_aggregate(leaf, fine, sums, by).select("level", "id", *by, *measures)
    high = level_aggregate(materialize(rest, "upper"), {k: v for k, v in levels.items() if k not in fine}, sums, by)
    return low.unionByName(high.select("level", "id", *by, *measures))


def level_cardinality(df: DataFrame, levels: Mapping[int, Sequence[str]]) -> DataFrame:
    """AG9: number of distinct series per level (leaf rows in, one row per level out)."""
    lv = level_aggregate(df, levels, [F.count(F.lit(1)).alias("_n")])
    return lv.groupBy("level").agg(F.count("id").alias("n_series"))
