import math
from collections import Counter

import cases
from pyspark.sql import functions as F

from tabularlab.llm import mixing


def test_same_counts_whatever_the_partitions(spark):
    docs = cases.documents(spark)
    key = lambda df: sorted((str(r.doc_id), str(r.text)[:30], r.copy, r.shuffle_key) for r in df.collect())
    assert key(mixing.mix_sources(docs, total=60.0)) == key(mixing.mix_sources(docs.repartition(7), total=60.0))


def test_poisson_counts(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15000, "hot").when(F.col("id") < 19990, "b")
                                     .otherwise(None).alias("source"))
    mixed = mixing.mix_sources(docs, {"hot": 0.2, "b": 0.8}, total=20000.0)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"hot", "b"} and abs(n["hot"] - 4000) < 320 and abs(n["b"] - 16000) < 640
    per_doc = Counter(r["count"] for r in mixed.where("source = 'b'").groupBy("doc_id").count().collect())
    rate = 16000 / 4990
    for k in (1, 3, 5):
        want = 4990 * math.exp(-rate) * rate ** k / math.factorial(k)
        assert abs(per_doc[k] - want) < 5 * math.sqrt(want)


def test_large_rates_add_up(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    assert abs(mixing.mix_sources(docs, total=40 * 500.0).count() - 20000) < 5 * math.sqrt(20000)


def test_clashing_columns_and_empty_table(spark):
    docs = cases.crowded(spark)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "_copy", "shuffle_key"]
    assert mixing.mix_sources(docs, with_keys=False).columns == docs.columns
    assert mixing.mix_sources(cases.empty(spark)).count() == 0
    assert mixing.mix_sources(docs, {}).count() == 0


def test_main_path_has_no_python(spark):
    plan = mixing.mix_sources(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
