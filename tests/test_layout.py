"""Physical layout, the preprocessor and indicators of many values."""

import pytest
from pyspark.sql import functions as F

from tabularlab.operators import reshape as R
from tabularlab.operators.preprocess import TabularModel, TabularPreprocessor
from tabularlab.sources import files as IO


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the scan of a filtered read hands on."""
    assert df.collect() is not None
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_bucketed_tables_join_and_group_without_an_exchange(spark):
    a = spark.range(2000).withColumn("x", F.col("id") % 7)
    b = spark.range(6000).select((F.col("id") % 2000).alias("k"), F.lit(1).alias("y"))
    ta = IO.write_bucketed(a, IO.run_folder(spark, "t-a"), ["id"], 4)
    tb = IO.write_bucketed(b, IO.run_folder(spark, "t-b"), ["k"], 4)
    joined = spark.table(ta).hint("merge").join(spark.table(tb), F.col("id") == F.col("k"))
    out = joined.groupBy("id", "x").agg(F.sum("y").alias("n"))
    assert "Exchange" not in plan_of(out)
    assert {(r.id, r.x, r.n) for r in out.collect()} == {(i, i % 7, 3) for i in range(2000)}


def test_point_reads_pass_over_row_groups(spark):
    # the order of ``tag`` has nothing to do with that of the key: only the Bloom filters know where a tag is
    df = spark.range(200_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("tag"))
    path = IO.write_sorted(df, IO.run_folder(spark, "t-sorted"), ["k"], 1 << 18, ["tag"], 20_000)
    plain = IO.write_sorted(df, IO.run_folder(spark, "t-plain"), ["k"], 1 << 18)
    rows = spark.read.parquet(path)
    by_key, by_tag = rows.where("k = 123456"), rows.where(F.col("tag") == F.md5(F.lit("77")))
    assert by_key.first().tag and by_tag.first().k == 77
    assert rows_read(rows.where("k = 123456")) < 50_000
    with_filter = rows_read(rows.where(F.col("tag") == F.md5(F.lit("77"))))
    assert with_filter < 50_000 and with_filter < rows_read(spark.read.parquet(plain).where(F.col("tag") == F.md5(F.lit("77"))))


def test_preprocessor_is_fitted_saved_and_loaded_in_another_session(spark):
    schema = "id long, x double, city string, size int"
    train = spark.createDataFrame([(1, 1.0, "b", 3), (2, 3.0, "a", 1), (3, None, None, 1), (4, 8.0, "b", None)], schema)
    valid = spark.createDataFrame([(5, None, "a", 1), (6, 4.0, "z", 9), (7, 1.0, None, None)], schema)
    path = IO.run_folder(spark, "t-prep")
    TabularPreprocessor(["x"], ["city", "size"]).fit(train).save(path)
    other = spark.newSession()
    model = TabularModel.load(other, path)
    got = {r.id: r for r in model.transform(other.createDataFrame(valid.collect(), schema)).collect()}
    mean, std = 4.0, 13.0 ** 0.5
    assert got[5].x == pytest.approx((3.0 - mean) / std) and got[5].x_na == 1          # the median of training
    assert got[6].x == pytest.approx(0.0) and got[6].x_na == 0
    assert [(got[i].city_code, got[i].size_code) for i in (5, 6, 7)] == [(1, 1), (0, 0), (0, 0)]
    assert {r.city: r.city_code for r in model.transform(train).collect()} == {"a": 1, "b": 2, None: 0}
    with pytest.raises(Exception):
        TabularPreprocessor(["x"]).fit(train).save(path)                             # no silent overwrite
    TabularPreprocessor(["x"]).fit(train).write().overwrite().save(path)
    assert TabularModel.load(spark, path).categories == []


def test_both_indicator_forms_agree(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "b")], "id long, v string")
    values = R.distinct_values(df, "v")
    wide = {r.id: [r[f"v_{x}"] for x in values] for r in R.one_hot(df, "v", values).collect()}
    rows, codes = R.one_hot_vector(df, "v", "ind")
    assert {r.id: [int(x) for x in r.ind.toArray()] for r in rows.collect()} == wide
    assert [r.value for r in codes.orderBy("code").collect()] == values == ["a", "b", "c"]
    with pytest.raises(ValueError):
        R.distinct_values(df, "v", limit=2)


def test_table_function_over_partitions_in_sql(spark):
    R.name_rows(spark)
    spark.createDataFrame([(i, f"[{{'name': 'n{i % 3}'}}, {{'id': None}}, {{'name': \"It's\"}}]") for i in range(30)]
                          + [(100, None), (101, "False")], "id long, t string").createOrReplaceTempView("literal_lists")
    got = spark.sql("""select name, count(*) as n from name_rows(table(select id, t, id % 4 as part from literal_lists) partition by part)
                       group by name""").collect()
    assert {r.name: r.n for r in got} == {"n0": 10, "n1": 10, "n2": 10, "It's": 30}
