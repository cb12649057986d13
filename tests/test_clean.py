"""Cleaning operators on literal frames."""

import pytest
from pyspark.sql import functions as F

from tabularlab.operators import aggs as A
from tabularlab.operators import clean as C


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "a", " 12 ", None), (2, "b", "x7", 3.5), (3, None, "NA", None)],
                                 "id int, cat string, raw string, val double")


def test_select_columns(df):
    assert C.select_columns(df, pattern="^(c|r)").columns == ["cat", "raw"]
    assert C.select_columns(df, start="cat", end="val", exclude=["raw"]).columns == ["cat", "val"]


def test_patch_and_map(df):
    got = [r.cat for r in C.patch_values(df, "cat", {"a": "A"}).orderBy("id").collect()]
    assert got == ["A", "b", None]
    got = [r.m for r in C.map_values(df, "cat", {"a": 1}, "m").orderBy("id").collect()]
    assert got == [1, None, None]


def test_coerce_numeric(spark, df):
    got = [r.raw for r in C.coerce_numeric(df, "raw", digits_only=True).orderBy("id").collect()]
    assert got == [12, None, None]
    with pytest.raises(Exception):
        C.coerce_numeric(df, "raw", strict=True).collect()


def test_null_profile_and_drop(df):
    prof = {r["column"]: (r["n_null"], r["n_rows"]) for r in C.null_profile(df).collect()}
    assert prof == {"id": (0, 3), "cat": (1, 3), "raw": (0, 3), "val": (2, 3)}
    assert C.drop_all_null_columns(df.withColumn("empty", F.lit(None).cast("int"))).columns == df.columns


def test_record_transpose(df):
    rows = {r.field: r.value for r in C.record_transpose(df.where("id = 2")).collect()}
    assert rows == {"id": "2", "cat": "b", "raw": "x7", "val": "3.5"}


def test_value_counts_keep_nulls(df):
    got = {r.cat: r["count"] for r in A.value_counts(df, "cat", dropna=False).collect()}
    assert got == {"a": 1, "b": 1, None: 1}


def test_medians_beside_other_functions_and_null_groups(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0), (None, 3.0), (None, 9.0), ("b", None)] + [("hot", 5.0)] * 500 + [("hot", 7.0)]
    t = spark.createDataFrame(rows, "k string, v double")
    got = C.flatten_agg_names(t, ["k"], {"v": ["max", "median", "count"]})
    assert got.columns == ["k", "v_max", "v_median", "v_count"]
    assert {tuple(r) for r in got.collect()} == {("a", 4.0, 2.5, 2), (None, 9.0, 3.0, 3), ("b", None, None, 0), ("hot", 7.0, 5.0, 501)}
    assert "Percentile" not in got._jdf.queryExecution().toString() and "Median" not in got._jdf.queryExecution().toString()
    assert C.flatten_agg_names(t, [], {"v": ["median", "min"]}).collect() == [(5.0, 1.0)]
    assert {tuple(r) for r in C.flatten_agg_names(t, ["k"], {"v": ["median"]}).collect()} == {("a", 2.5), (None, 3.0), ("b", None), ("hot", 5.0)}


def test_crosstab_of_the_values_that_occur(spark):
    t = spark.createDataFrame([("x", "p"), ("x", "q"), ("x", "q"), ("y", "p"), ("y", None)], "r string, c string")
    assert {tuple(r) for r in A.crosstab(t, "r", "c").collect()} == {("x", 1, 2), ("y", 1, 0)}
    assert A.crosstab(t, "r", "c").columns == ["r", "c_p", "c_q"]


def test_lookups_are_broadcast_by_their_counted_size(spark, monkeypatch):
    from tabularlab.operators import joins as J
    left = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id long, k long")
    lookup = spark.createDataFrame([(10, "ten"), (20, "twenty")], "n long, name string")
    got = {r.id: r.name for r in J.enrich(left, lookup, "k", "n", fixed_size=True).collect()}
    assert got == {1: "ten", 2: None, 3: None}
    plan = J.enrich(left, lookup, "k", "n", fixed_size=True)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan
    monkeypatch.setattr(J, "FIXED_ROWS", 1)
    wide = J.enrich(left, lookup, "k", "n", fixed_size=True)
    assert "broadcast" not in wide._jdf.queryExecution().analyzed().toString()
    assert {r.id: r.name for r in wide.collect()} == got
