"""Registered queries against their SQL, and the pipeline against a brute-force version."""

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabularlab.llm import bpe, quality, queries
from tabularlab.sources.tables import TABLES

sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))
from oracle_check import rows_of, type_mismatches  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert type_mismatches(df, con, queries.ORACLE[name]) == []
    assert rows_of(df.toPandas()) == rows_of(con.execute(queries.ORACLE[name]).fetchdf())


def test_every_operator_has_its_query():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 14))


def test_pipeline_equals_brute_force(spark):
    import test_linededup
    import test_simhash
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()), key=repr)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    kept = [r for r in rows if not any(rule.rejects(quality.Features(r[1])) for rule in quality.RULES)]
    lines = test_linededup.brute([r[:2] for r in kept], test_linededup.by_length)      # the stage's own rule
    cut = [(i, lines[i, t], s) for i, t, s in kept if lines[i, t] == t or (lines[i, t] or "").strip(" \t\n\x0b\x0c\r")]
    groups = {i: c for i, _, c in test_simhash.expected([r[:2] for r in cut])}
    one = [r for r in cut if groups[r[0]] == r[0]]
    frame = spark.createDataFrame(one, "doc_id long, text string, source string")
    assert frame.count() == len(one)
    code, want = bpe.load(queries.tokenizer("word_bpe_49k.json")), []
    n = {s: sum(r[2] == s for r in one) for _, _, s in one}
    root = sum(v ** 0.5 for v in n.values())
    for i, text, s in one:
        mean = len(one) * (n[s] ** 0.5 / root) / n[s]
        u = int(hashlib.md5(f"20:{i}:1".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = total = 2.718281828459045 ** -mean
        copies = 0
        while total <= u:
            copies += 1
            p *= mean / copies
            total += p
        want += [(i, *code.digest(text or ""))] * copies
    assert got == sorted(want, key=repr)


def test_each_stage_takes_awkward_documents(spark):
    import cases
    for docs in (cases.documents(spark), cases.crowded(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns, name
            assert (after.count() > 0) == (docs.count() > 0), name


def test_line_stage_keeps_a_clean_document(spark):
    import cases
    docs = spark.createDataFrame([(1, cases.GOOD, "en", "a", len(cases.GOOD)), (2, cases.OTHER, "en", "a", len(cases.OTHER)),
                                  (3, cases.GOOD, "en", "b", len(cases.GOOD))], cases.SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.line_stage(spark, docs, SMALL).collect()) == [1, 2]
    assert docs.where(F.col("doc_id") < 3).collect() == corpus_pipeline.line_stage(spark, docs.where("doc_id < 3"), SMALL).orderBy("doc_id").collect()
