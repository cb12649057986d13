"""Reshape operators (RS1-RS7): melt, pivot, explode, one-hot."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularlab.operators.joins import assert_unique


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable",
         val: str = "value") -> DataFrame:
    """RS1: wide -> long (a narrow Expand; no shuffle)."""
    return df.unpivot(list(ids), list(values), var, val)


def melt_flags(df: DataFrame, ids: Sequence[str], flag_cols: Sequence[str], sep: str = "_",
               part: int = 2, key: str = "state", flag: str = "flag") -> DataFrame:
    """RS2: melt flag columns named ``prefix<sep>KEY`` into (key, flag)."""
    long = df.unpivot(list(ids), list(flag_cols), "_name", flag)
    return long.withColumn(key, F.split_part(F.col("_name"), F.lit(sep), F.lit(part))).drop("_name")


def pivot_wide(df: DataFrame, index: Sequence[str], column: str, value: str,
               values: Mapping[object, str], check_unique: bool = True) -> DataFrame:
    """RS3: long -> wide with explicit column values (no extra distinct job).
    A duplicate (index, column) pair raises, as pandas' pivot does."""
    if check_unique:
        assert_unique(df, [*index, column], "pivot")
    p = df.groupBy(*index).pivot(column, list(values)).agg(F.first(value))
    return p.select(*index, *[F.col(f"`{v}`").alias(name) for v, name in values.items()])


def relabel_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """RS4: header re-labelling (e.g. F1..F28 <-> dates); no data movement."""
    return df.withColumnsRenamed(dict(mapping))


def _literal_names(text: pd.Series) -> pd.Series:
    """Names from Python-literal lists of dicts; anything else gives an empty list."""
    def one(t):
        if t is None:
            return []
        try:
            value = ast.literal_eval(t)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        if not isinstance(value, list):
            return []
        names = [d.get("name") for d in value if isinstance(d, dict)]
        return [n if isinstance(n, str) else str(n) for n in names if n is not None]
    return text.map(one)


def name_rows(spark):
    """Section 2.14: a table function for list-returning parsers, registered as ``name_rows``: takes a table
    (key, text), in partitions of the caller's choice, and gives (key, name) rows, an Arrow batch at a time."""
    import pyarrow as pa

    @F.arrow_udtf(returnType="key bigint, name string")
    class NameRows:
        def eval(self, batch):
            key, text = batch.column(0).to_pylist(), pd.Series(batch.column(1).to_pylist(), dtype=object)
            found = [(k, n) for k, names in zip(key, _literal_names(text)) for n in names]
            yield pa.table({"key": pa.array([k for k, _ in found], pa.int64()), "name": pa.array([n for _, n in found], pa.string())})

    spark.udtf.register("name_rows", NameRows)
    return NameRows


def parse_name_list(text: Column) -> Column:
    """RS5: names from a list-of-dicts held as text, e.g. "[{'id': 1, 'name': 'X'}]".
    Valid JSON is parsed in the JVM; other rows go to a batched Python-literal
    parser (quotes of either kind, None, True).  Malformed or non-list text
    (``False``, null) gives an empty list."""
    json = F.try_parse_json(text).isNotNull()
    empty = F.array().cast("array<string>")
    parsed = F.from_json(F.when(json, text), "array<struct<name:string>>")
    names = F.filter(F.transform(parsed, lambda s: s["name"]), lambda x: x.isNotNull())
    literal = F.pandas_udf(_literal_names, "array<string>")(F.when(~json, text))
    return F.when(json, F.coalesce(names, empty)).otherwise(F.coalesce(literal, empty))


def explode_counts(df: DataFrame, list_col: str, out: str = "name") -> DataFrame:
    """RS5: count of rows per list element."""
    return df.select(F.explode(list_col).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("count"))


def explode_mean(df: DataFrame, list_col: str, value: str, out: str = "name", digits: int = 6) -> DataFrame:
    """RS6: mean of a parent measure per list element."""
    e = df.select(F.explode(list_col).alias(out), F.col(value))
    return e.groupBy(out).agg(F.round(F.avg(value), digits).alias(f"mean_{value}"),
                              F.count(F.lit(1)).alias("n"))


def one_hot(df: DataFrame, col: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """RS7 / D12: indicator columns for explicit values; null -> all zeros."""
    prefix = prefix or col
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
                           for v in values})


MAX_COLUMNS = 1000           # values that may become columns


def distinct_values(df: DataFrame, col: str, limit: int = MAX_COLUMNS) -> list:
    """Sorted distinct values of a column whose values become columns (one-hot, pivot).  More than
    ``limit`` of them raise: such a column takes ``one_hot_vector``."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()      # bounded by the limit
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values; use one_hot_vector")
    return sorted(r[0] for r in rows)


def one_hot_vector(df: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """RS7 for columns of many values: ``df`` with a sparse indicator vector, and its table (value, code).
    Positions follow the values' order.  The table is numbered by Spark and joined by value;
    the driver learns its size only.  A null gives a vector without entries."""
    from pyspark.ml.feature import OneHotEncoder
    from tabularlab.operators.features import fit_label_encoder
    from tabularlab.session import materialize
    codes = materialize(fit_label_encoder(df, col), "one-hot")
    n = codes.count()
    coded = df.join(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), F.col(f"`{col}`") == F.col("_value"), "left") \
        .withColumn("_code", F.coalesce("_code", F.lit(n)).cast("double"))
    # the last category stands for null and is dropped
    sized = codes.select(F.col("code").cast("double").alias("_code")).unionByName(df.sparkSession.range(1).select(F.lit(float(n)).alias("_code")))
    model = OneHotEncoder(inputCols=["_code"], outputCols=[out], dropLast=True).fit(sized)
    return model.transform(coded).drop("_value", "_code"), codes
