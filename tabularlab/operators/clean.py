"""Projection, filtering and cleaning operators (PRJ1-PRJ19, SRC5)."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_columns(df: DataFrame, include: Sequence[str] | None = None, pattern: str | None = None,
                   exclude: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """PRJ1: projection by list, name pattern (regex search), column range and exclusion list.

    The choice is made on the schema (driver side, no job); Catalyst then
    prunes the parquet scan to the kept columns.
    """
    cols = list(df.columns)
    if start is not None or end is not None:
        i = cols.index(start) if start is not None else 0
        j = cols.index(end) if end is not None else len(cols) - 1
        cols = cols[i:j + 1]
    if include is not None:
        cols = [c for c in cols if c in include]
    if pattern is not None:
        rx = re.compile(pattern)
        cols = [c for c in cols if rx.search(c)]
    cols = [c for c in cols if c not in set(exclude)]
    return df.select(*cols)


def keep_members(df: DataFrame, col: str, values: Sequence | DataFrame, other_col: str | None = None) -> DataFrame:
    """PRJ3: membership filter. Literal lists become ``isin``; a DataFrame of keys
    becomes a left-semi join (which AQE broadcasts only if it measures small)."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(other_col or col).alias("_k")).where(F.col("_k").isNotNull())
        return df.join(keys, F.col(col) == F.col("_k"), "left_semi")
    return df.where(F.col(col).isin(list(values)))


def coerce_numeric(df: DataFrame, col: str, out: str | None = None, to: str = "bigint",
                   digits_only: bool = False, strict: bool = False) -> DataFrame:
    """PRJ6: text -> number.  Non-numbers become null (``try_cast``) unless
    ``strict``, which raises like a plain ANSI cast; ``digits_only`` first
    requires the text to be all digits."""
    c = F.trim(F.col(col).cast("string"))
    if digits_only:
        c = F.when(c.rlike("^[0-9]+$"), c)
    casted = c.cast(to) if strict else c.try_cast(to)
    return df.withColumn(out or col, casted)


def patch_values(df: DataFrame, col: str, patch: Mapping[str, str], out: str | None = None) -> DataFrame:
    """PRJ8: replace known spellings through a patch table (its size is the
    size of the mapping, so the broadcast is bounded)."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(patch.items()), "_old string, _new string")
    j = df.join(F.broadcast(table), F.col(col) == F.col("_old"), "left")
    return j.withColumn(out or col, F.coalesce(F.col("_new"), F.col(col))).drop("_old", "_new")


def map_values(df: DataFrame, col: str, mapping: Mapping, out: str) -> DataFrame:
    """PRJ9: dictionary map; unmapped keys -> null.  The mapping is a literal
    map expression evaluated inside codegen."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return df.withColumn(out, F.create_map(*pairs)[F.col(col)])


def null_indicators(df: DataFrame, cols: Sequence[str], suffix: str = "_na") -> DataFrame:
    """PRJ10: ``c_na = isnull(c) as int`` for each column."""
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in cols})


def null_profile(df: DataFrame) -> DataFrame:
    """PRJ13: (column, n_null, n_rows) for every column, from one aggregation pass."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = one.unpivot(["_rows"], list(df.columns), "column", "n_null")
    return long.select("column", "n_null", F.col("_rows").alias("n_rows"))


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """SRC5: drop columns that are null in every row (one aggregation pass; the
    driver receives one row of per-column counts)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def flatten_agg_names(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]],
                      sep: str = "_") -> DataFrame:
    """PRJ14: multi-function aggregation whose output names are ``column_function``.

    Medians come from counted values (``exact_quantiles``), so that no task holds a group's values."""
    from tabularlab.operators.quantiles import exact_median
    fns = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
           "std": F.stddev_samp, "nunique": F.countDistinct}
    wanted = [(c, f, f"{c}{sep}{f}") for c, fs in spec.items() for f in fs]
    exprs = [fns[f](c).alias(name) for c, f, name in wanted if f != "median"]
    out = df.groupBy(*keys).agg(*exprs) if exprs else df.select(*keys).distinct()
    for c, f, name in wanted:
        if f == "median":
            m = exact_median(df, keys, c, name).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            out = out.join(m, functools.reduce(lambda x, y: x & y, same, F.lit(True)), "left")
    return out.select(*keys, *[name for _, _, name in wanted])


def record_transpose(df: DataFrame, fields: Sequence[str] | None = None,
                     field_col: str = "field", value_col: str = "value") -> DataFrame:
    """PRJ15: rows -> (field, value) pairs with values cast to string."""
    fields = list(fields or df.columns)
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in fields])
    return cast.unpivot([], fields, field_col, value_col)


def clip_renormalise(arr: Column, m: float) -> Column:
    """PRJ16: clip each probability to [1 - m, m] and divide by the row sum."""
    clipped = F.transform(arr, lambda x: F.least(F.greatest(x.cast("double"), F.lit(1.0 - m)), F.lit(m)))
    total = F.aggregate(clipped, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(clipped, lambda x: x / total)


def power_columns(df: DataFrame, col: str, degrees: Sequence[int]) -> DataFrame:
    """PRJ17: x^d columns named ``col_pow_d``."""
    return df.withColumns({f"{col}_pow_{d}": F.pow(F.col(col).cast("double"), F.lit(float(d)))
                           for d in degrees})


def schema_profile(df: DataFrame) -> DataFrame:
    """PRJ18: (column, data_type, position, n_rows) - one count job."""
    n = df.count()
    rows = [(f.name, f.dataType.simpleString(), i, n) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, data_type string, position int, n_rows bigint")
