"""Sources and sinks on small literal data (written under the shared checkpoint folder)."""

import pytest
from pyspark.sql import functions as F

from tabularlab.sources import files as IO


def test_csv_declared_schema_fails_fast_on_bad_rows(spark):
    path = IO.run_folder(spark, "t-csv")
    spark.createDataFrame([("1", "x"), ("oops", "y")], "a string, b string").coalesce(1).write.option("header", True).csv(path)
    with pytest.raises(Exception):
        IO.read_csv(spark, path, schema="a int, b string").collect()
    assert IO.read_csv(spark, path).count() == 2          # inferred schema reads both rows


def test_build_once_does_not_rebuild(spark):
    path = IO.run_folder(spark, "t-once")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert IO.build_once(spark, path, build).count() == 3
    assert IO.build_once(spark, path, build).count() == 3
    assert IO.build_once(spark, path, build, force=True).count() == 3
    assert len(calls) == 2


def test_word_vectors_header_and_vocabulary(spark):
    base = IO.run_folder(spark, "t-vec")
    spark.createDataFrame([("2 3",)], "value string").write.text(base + "/h")
    spark.createDataFrame([("a 1.0 2.0 3.0",), ("b 0.5 0.25 0.125",)], "value string").write.text(base + "/b")
    vocab = spark.createDataFrame([("b",)], "token string")
    rows = IO.read_word_vectors(spark, base, vocab).collect()
    assert [(r.token, list(r.vector)) for r in rows] == [("b", [0.5, 0.25, 0.125])]
