import zlib

import cases
import pytest
from pyspark.sql import functions as F

from tabularlab.llm import sharding


def check(df, rows, shards, slack):
    got = df.collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, size(t), crc(t)) for i, t in rows), key=repr)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    order = []
    for s in sorted(by_shard):
        by_shard[s].sort(key=lambda r: r.slot)
        assert [r.slot for r in by_shard[s]] == list(range(len(by_shard[s])))
        order += [(r.text_crc32, -1 if r.doc_id is None else r.doc_id) for r in by_shard[s]]
    assert order == sorted(order) and set(by_shard) <= set(range(shards))
    target = sum(r.size for r in got) / shards
    sums = [sum(r.size for r in by_shard.get(s, [])) for s in range(shards)]
    assert max(sums) <= target + slack and min(sums) >= target - slack
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


@pytest.mark.parametrize("range_bytes", [1 << 30, 500])
def test_a_hot_text_is_cut_by_id(spark, range_bytes):
    rows = [(i, "the same text for all of these rows" if i % 3 else f"text {i} " * (i % 17)) for i in range(900)]
    df = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, range_bytes=range_bytes)
    check(df, rows, 8, 2 * 160)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    df = sharding.assign_shards(cases.documents(spark).select("doc_id", "text"), shards=3)
    check(df, rows, 3, max(len((t or "").encode()) + 8 for _, t in rows))


def test_wide_ids_few_rows_and_empty_table(spark):
    rows = [(-(1 << 62), "a"), (1 << 62, "a"), (0, "a")]
    df = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.slot for r in df.collect()) in ([0, 0, 0], [0, 0, 1], [0, 1, 2])
    assert sharding.assign_shards(cases.empty(spark)).count() == 0


def test_clashing_columns(spark):
    docs = cases.crowded(spark)
    assert sharding.assign_shards(docs).columns == [*docs.columns, "_size", "text_crc32", "law", "_shard", "_slot", "grown_shard"]


def test_main_path_has_no_python(spark):
    plan = sharding.assign_shards(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
