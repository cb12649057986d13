"""pandas -> Spark semantic rules D1-D13 and the distributed building blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularlab.operators import aggs as A
from tabularlab.operators import features as FT
from tabularlab.operators import joins as J
from tabularlab.operators import reshape as R
from tabularlab.operators.order import with_row_number
from tabularlab.operators.quantiles import exact_quantiles


def test_d1_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 10), (1, 20)], "j int, y int")
    assert J.join_on(a, b, ["k"], ["j"], "inner").count() == 1
    assert J.join_on(a, b, ["k"], ["j"], "inner", null_safe=True).count() == 2


def test_d2_value_counts_drop_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "c string")
    got = {r["c"]: (r["count"], r["share"]) for r in A.value_counts(df, "c").collect()}
    assert got == {"a": (2, round(2 / 3, 6)), "b": (1, round(1 / 3, 6))}


def test_d4_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in df.orderBy(F.col("x").asc_nulls_last()).collect()] == [1, 3, None]
    assert [r.x for r in df.orderBy(F.col("x").desc_nulls_last()).collect()] == [3, 1, None]


def test_d8_regex_no_match_is_null(spark):
    from tabularlab.functions.strings import extract_groups
    df = spark.createDataFrame([("abc",), ("x12",)], "t string")
    got = [r["d"] for r in df.select(extract_groups(F.col("t"), "([0-9]+)", ["d"])[0]).collect()]
    assert got == [None, "12"]


def test_d9_truncating_cast(spark):
    assert spark.createDataFrame([(-2.7,)], "x double").select(F.col("x").cast("int")).first()[0] == -2


def test_d12_one_hot_null(spark):
    df = spark.createDataFrame([("F",), (None,)], "s string")
    r = R.one_hot(df, "s", ["F", "O"]).collect()
    assert [(x["s_F"], x["s_O"]) for x in r] == [(1, 0), (0, 0)]


def test_d13_bias_corrected_skew(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0]
    df = spark.createDataFrame([(1, v) for v in vals], "p int, x double")
    got = FT.parent_aggregate_features(df, "p", ["x"]).first()["skew_x"]
    x = np.array(vals)
    n = len(x)
    m2, m3 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean()
    g1 = m3 / m2 ** 1.5
    assert got == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2), abs=1e-6)


def test_pivot_duplicate_raises(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "i int, c string, v double")
    with pytest.raises(J.JoinValidationError):
        R.pivot_wide(df, ["i"], "c", "v", {"a": "a"})


def test_exact_quantiles_with_hot_group(spark):
    """One group holds most rows; result must equal numpy's linear interpolation."""
    rnd = random.Random(7)
    rows = [("hot", rnd.random() * 100) for _ in range(3000)] + \
           [(f"g{i % 7}", rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: (r["q_0"], r["q_1"], r["q_2"]) for r in exact_quantiles(df, ["g"], "x", [0.1, 0.5, 0.9]).collect()}
    for g in {k for k, _ in rows}:
        xs = np.array([v for k, v in rows if k == g])
        assert got[g] == pytest.approx(tuple(np.percentile(xs, [10, 50, 90])), rel=1e-12)


def test_row_number_is_global_and_partition_independent(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000).repartition(7)
    out = with_row_number(df, ["k"], "rn").select("k", "rn").collect()
    assert sorted((r.k, r.rn) for r in out) == [(k, k + 1) for k in range(5000)]
    one = with_row_number(df.coalesce(1), ["k"], "rn", num_partitions=1).select("k", "rn").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, out))


def test_share_of_total_and_histogram(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    got = {(r.g, r.x): r.share for r in A.share_of_total(df, ["g"], "x").collect()}
    assert got == {("a", 1.0): 0.25, ("a", 3.0): 0.75, ("b", 5.0): 1.0}
    h = {r["bin"]: r["count"] for r in A.histogram(df, "x", 2).collect()}
    assert h == {1: 1, 2: 2}     # the maximum falls in the last bin


def test_single_value_check_raises(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v int")
    with pytest.raises(A.SingleValueError):
        A.assert_single_value(df, ["g"], "v")


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert A.value_counts(df, "g").count() == 0
    assert A.count_of_counts(df, ["g"]).count() == 0


def test_partition_filter_guard(spark, tmp_path):
    from tabularlab.sources import files as IO
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    path = IO.write_partitioned(df, IO.run_folder(spark, "guard"), ["p"])
    assert IO.scan_partitions(spark, path, "p", "^a$", ["x"]).count() == 1
    with pytest.raises(IO.PartitionFilterError):
        IO.scan_partitions(spark, path, "p", ".*")
    with pytest.raises(IO.PartitionFilterError):
        IO.scan_partitions(spark, path, "p", "^zzz$")


def test_neighbours_without_group_window(spark):
    from pyspark.sql import Window
    from tabularlab.operators.order import folds_within_groups, neighbour_values
    rows = [("hot", i, float((i * 37) % 101)) for i in range(400)] + [("a", i, float(i)) for i in range(3)] + \
           [(None, i, float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "g string, t int, v double").repartition(6)
    got = {(r.g, r.t): (r.prev_value, r.next_value) for r in neighbour_values(df, ["g"], ["t"], "v").collect()}
    w = Window.partitionBy("g").orderBy("t")
    want = {(r.g, r.t): (r.p, r.n) for r in df.select("g", "t", F.lag("v").over(w).alias("p"),
                                                        F.lead("v").over(w).alias("n")).collect()}
    assert got == want
    f = folds_within_groups(df, ["g"], ["t"], 3)
    want_f = {(r.g, r.t): r.f for r in df.select("g", "t", F.ntile(3).over(w).alias("f")).collect()}
    assert {(r.g, r.t): r.fold for r in f.collect()} == want_f


def test_pipe_and_tap(spark):
    from tabularlab.functions.hooks import pipe, tap
    seen = []
    df = spark.range(5)
    out = df.transform(pipe(lambda d: d.where("id > 1"), tap("filtered", lambda n, d: seen.append((n, d.count()))),
                            lambda d: d.selectExpr("id * 2 as x")))
    assert [r.x for r in out.collect()] == [4, 6, 8] and seen == [("filtered", 3)]


def test_holdout_class_check(spark):
    df = spark.createDataFrame([(1, "s1", "en"), (2, "s2", "en"), (3, "s2", "fr")], "id int, src string, lang string")
    chosen = df.where("src = 's1'").select("src")
    split = FT.group_holdout(df, "src", chosen)
    with pytest.raises(FT.MissingClassError):
        FT.assert_classes_on_both_sides(split, "split", "lang")


def test_one_partition_equals_many(spark):
    from tabularlab.operators.hierarchy import SALES_LEVELS, level_aggregate
    from tabularlab.operators.text import top_words
    from tabularlab.plans.facts import monthly_sales
    from tabularlab.sources.tables import Tables
    from conftest import SF_SMALL
    t = Tables(spark, SF_SMALL)
    f = monthly_sales(t)

    def both(fn, df):
        one = sorted(map(tuple, fn(df.coalesce(1)).collect()), key=repr)
        many = sorted(map(tuple, fn(df.repartition(7)).collect()), key=repr)
        return one, many

    one, many = both(lambda d: level_aggregate(d, SALES_LEVELS, [F.sum("sales").alias("s")], by=["m"]), f)
    assert one == many
    one, many = both(lambda d: exact_quantiles(d, ["cat_id"], "sales", [0.25, 0.5]), f)
    assert one == many
    one, many = both(lambda d: top_words(d, "lang", "text", 5), t.documents)
    assert one == many


def test_correlation_with_a_value_that_never_varies(spark):
    import math

    from tabularlab.operators.aggs import correlation, correlation_matrix
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 1.0), (4.0, 5.0, None), (None, 7.0, 3.0)], "x double, c double, y double")
    got = {(r.col_a, r.col_b): r.corr for r in correlation_matrix(df, ["x", "c", "y"]).collect()}
    assert math.isnan(got["x", "c"]) and got["x", "x"] == 1 and got["x", "y"] == -1         # c is 5 wherever x is known
    assert got["c", "y"] == round(float(np.corrcoef([5, 5, 7], [2, 1, 3])[0, 1]), 6)
    assert df.where("x is null").agg(correlation("x", "y").alias("r")).first().r is None


def test_target_correlation_of_parts_with_one_price(spark, tmp_path):
    """More equal prices than the hundred rows taken from either end."""
    import math

    from tabularlab.plans.q_aggs import ag18
    rows = [(i, i % 50 + 1, 900.0 if i < 150 else 999.9) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.subset: r["corr"] for r in ag18(spark, str(tmp_path)).collect()}
    assert math.isnan(got["top100"]) and math.isnan(got["bottom100"]) and math.isnan(got["top_minus_bottom"])
    assert not math.isnan(got["all"])
