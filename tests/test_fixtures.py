"""Literal fixtures FX1-FX12 (expected values worked out by hand)."""

import math

import pytest
from pyspark.sql import functions as F

from tabularlab.functions.arrays import pad_left, sliding_windows
from tabularlab.functions.strings import first_match
from tabularlab.operators import features as FT
from tabularlab.operators import joins as J
from tabularlab.operators import reshape as R
from tabularlab.operators import series as S
from tabularlab.operators.metrics import wrmsse
from tabularlab.operators.order import contiguous_folds

LEVELS = {1: [], 12: ["id"]}


def _fx1(spark):
    rows = []
    for day in range(10):
        rows.append(("A", day, 1 if day % 2 == 0 else 0, 5.0))
        rows.append(("B", day, 0 if day % 2 == 0 else 2, 3.0))
    df = spark.createDataFrame(rows, "id string, day int, sales int, price double") \
        .withColumn("dollars", F.col("sales") * F.col("price"))
    mx = df.groupBy("id").agg(F.max("sales").alias("mx"))
    mirrored = df.join(mx, "id").withColumn("sales", F.col("mx") - F.col("sales")) \
        .withColumn("dollars", F.col("sales") * F.col("price")).drop("mx")
    train = df.where("day <= 5")
    return train, df.where("day >= 6"), mirrored.where("day >= 6")


def _score(r):
    return r.first()["wrmsse"]


def test_fx1_wrmsse_golden(spark):
    train, valid, mirrored = _fx1(spark)
    assert _score(wrmsse(train, valid, valid, LEVELS)) == pytest.approx(0.0)
    assert _score(wrmsse(train, valid, mirrored, LEVELS)) == pytest.approx(1.0)
    assert _score(wrmsse(train, mirrored, valid, LEVELS)) == pytest.approx(1.0)


def test_fx1_zero_scale_literal_rule(spark):
    """D5: a series with dollars but a flat train history is inf under the literal
    rule and contributes nothing under nullif."""
    rows = [("A", d, 2, 1.0) for d in range(6)] + [("A", d, 3, 1.0) for d in range(6, 8)]
    df = spark.createDataFrame(rows, "id string, day int, sales int, price double").withColumn(
        "dollars", F.col("sales") * F.col("price"))
    train, valid = df.where("day <= 5"), df.where("day >= 6")
    pred = valid.withColumn("sales", F.lit(0))
    assert math.isinf(_score(wrmsse(train, valid, pred, {12: ["id"]}, zero_scale="inf")))
    r = wrmsse(train, valid, pred, {12: ["id"]}).first()
    assert r["wrmsse"] is None and r["zero_scale_series"] == 1


def test_fx2_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "x double")
    assert FT.quantile_edges(df, "x", 4) == pytest.approx([1, 3.25, 5.5, 7.75, 10])
    sizes = {r["b"]: r["count"] for r in FT.quantile_bins(df, "x", 4, "b").groupBy("b").count().collect()}
    assert sizes == {1: 3, 2: 2, 3: 2, 4: 3}
    fixed = spark.createDataFrame([(2.0,), (6.0,), (0.0,), (15.0,)], "x double")
    got = {r["x"]: r["b"] for r in FT.fixed_bins(fixed, "x", [0, 2, 6, 14], "b", ["(0,2]", "(2,6]", "(6,14]"]).collect()}
    assert got == {2.0: "(0,2]", 6.0: "(2,6]", 0.0: None, 15.0: None}


def test_fx2_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,)], "x double")
    with pytest.raises(FT.DuplicateEdgesError):
        FT.quantile_edges(df, "x", 4)


def test_fx3_flips(spark):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([None, 3.0, 3.0, None, 2.0])],
                               "id string, t int, price double")
    r = S.on_off_changes(df, ["id"], "t", "price").first()
    assert (r["net_change"], r["flips"]) == (1.0, 3.0)


def test_fx4_launch_and_zero_months(spark):
    df = spark.createDataFrame([("s", i + 1, u) for i, u in enumerate([0, 0, 4, 0, 1, 0])], "id string, m int, u int")
    r = S.launch_and_zero_periods(df, ["id"], "m", "u").first()
    assert (r["launch_period"], r["zero_periods_after_launch"]) == (3, 2)


def test_fx5_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int").repartition(3)
    folds = {r["i"]: r["fold"] for r in contiguous_folds(df, ["i"], 3).collect()}
    assert [folds[i] for i in range(10)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_fx6_windows(spark):
    from tabularlab.operators.text import training_windows
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "doc int, seq array<int>")
    w = sorted(training_windows(df, "doc", "seq", 3).collect(), key=lambda r: r["start"])
    assert [list(r["window"]) for r in w] == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert [list(r["target"]) if r["target"] else None for r in w] == [[2, 3, 4], [3, 4, 5], None]
    assert df.select(sliding_windows(F.col("seq"), 6).alias("w")).first()["w"] == []


def test_fx7_padding(spark):
    df = spark.createDataFrame([([7, 8, 9],)], "a array<int>")
    r = df.select(pad_left(F.col("a"), 5).alias("p5"), pad_left(F.col("a"), 2).alias("p2")).first()
    assert list(r["p5"]) == [0, 0, 7, 8, 9] and list(r["p2"]) == [8, 9]


def test_fx8_target_encoding(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 0, True), ("b", 1, True), ("a", None, False),
                                ("b", None, False), ("c", None, False)], "cat string, y int, train boolean")
    out = FT.target_mean_encode(df, F.col("train"), "cat", "y", "enc").where(~F.col("train"))
    assert {r["cat"]: r["enc"] for r in out.collect()} == {"a": 0.5, "b": 1.0, "c": None}


def test_fx9_list_parsing(spark):
    df = spark.createDataFrame([(1, "[{'name': 'X'}, {'name': 'Y'}]"), (2, "False"), (3, None), (4, "[{'name': "),
                                (5, """[{'id': 1, 'name': "Ruby's Films"}, {'id': 2, 'name': 'Fox'}]"""),
                                (6, "[{'id': None, 'name': 'Fox'}]"), (7, "[{'name': 'A', 'ok': True}]"),
                                (8, '[{"name": "J"}, {"id": 1}, {"name": null}]'), (9, "7")], "i int, t string")
    got = {r["i"]: list(r["n"]) for r in df.select("i", R.parse_name_list(F.col("t")).alias("n")).collect()}
    assert got == {1: ["X", "Y"], 2: [], 3: [], 4: [], 5: ["Ruby's Films", "Fox"], 6: ["Fox"], 7: ["A"], 8: ["J"], 9: []}


def test_fx10_first_pattern(spark):
    classes = [("digits", "[0-9]+$"), ("slash form", "[A-Za-z.]+/[0-9A-Za-z.]* [0-9]+"),
               ("letters+digits", "[A-Za-z.]+ [0-9]+")]
    df = spark.createDataFrame([("113803",), ("PC 17599",), ("A/5 21171",), ("LINE",)], "t string")
    got = [r["c"] for r in df.select(first_match(F.col("t"), classes).alias("c")).collect()]
    assert got == ["digits", "letters+digits", "slash form", "-"]


def test_fx11_units(spark):
    df = spark.createDataFrame([(7.9, 2.0), (7.9, None)], "d double, p double")
    assert [r["u"] for r in df.select(FT.dollars_to_units(F.col("d"), F.col("p")).alias("u")).collect()] == [3, 0]


def test_fx12_checked_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "r1"), (2, "r2")], "k int, y string")
    assert sorted(J.checked_join(left, right, ["k"], validate="many_to_one").collect()) == \
        sorted(left.join(right, "k").collect())
    with pytest.raises(J.JoinValidationError, match="'k': 2"):
        J.checked_join(left, right, ["k"], validate="one_to_one")
