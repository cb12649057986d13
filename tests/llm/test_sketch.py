import hashlib
import re

import cases
import pytest
import xxhash
from pyspark.sql import functions as F

from tabularlab.llm import sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOP = 1 << 61
LOWEST = -(1 << 63)


def brute_hashes(text):
    words = WORD.findall(text)
    out = []
    for i in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[i:i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.append(h)
    return out


def brute_sketch(text):
    hashes = brute_hashes(text)
    return sorted({h for h in hashes if h < TOP}) or sorted(hashes)[:1]


def brute_print(s):
    return "".join(f"{h:016x}" for h in s)


def like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    def number(r):
        return LOWEST if r[0] is None else r[0]

    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-number(r), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        a, e, b = brute_sketch(text), brute_sketch(edited), brute_sketch(other)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(a), brute_print(e), like(a, e), like(a, b),
                    len(set(a) & set(e)) / len(a) if a else 1.0))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bucket_bytes", [1 << 28, 5000])
def test_equals_brute_force(spark, bucket_bytes):
    df = sketch.edited_report(cases.documents(spark), bucket_bytes=bucket_bytes)
    assert got(df) == expected(cases.rows())
    assert got(sketch.edited_report(cases.crowded(spark), bucket_bytes=bucket_bytes)) == expected(cases.rows())


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(sketch.edited_report(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(7, cases.GOOD)], "doc_id long, text string")
    assert got(sketch.edited_report(one)) == expected([(7, cases.GOOD)])
    assert sketch.edited_report(cases.empty(spark)).count() == 0


def test_no_python_and_one_exchange_of_texts(spark):
    plan = sketch.edited_report(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan


def test_merged_sketches_estimate_containment_of_unequal_texts(spark):
    words = [f"w{i}" for i in range(40_000)]
    parts = [(i, "all", " ".join(words[at:at + 5004])) for i, at in enumerate(range(0, 40_000, 5000))]
    small = (100, "part", " ".join(words[7000:7800] + [f"x{i}" for i in range(400)]))
    docs = spark.createDataFrame([*parts, small], "doc_id long, source string, text string")
    rows = sketch.merged_sketches(sketch.sketch_documents(docs), "source").cache()
    whole = spark.createDataFrame([(1, "all", " ".join(words))], docs.schema)
    merged = {r.hash for r in rows.where("group = 'all'").collect()}
    assert merged == set(sketch.sketch_documents(whole).first().sketch)
    share = sketch.contained_share(rows.where("group = 'part'"), rows.where("group = 'all'")).first().share
    assert abs(share - 796 / 1196) < 0.1
    back = sketch.contained_share(rows.where("group = 'all'"), rows.where("group = 'part'")).first().share
    assert abs(back - 796 / 39_996) < 0.02


def test_names_that_clash_and_bad_fractions(spark):
    docs = cases.documents(spark).withColumn("sketch", F.lit(1))
    assert sketch.sketch_documents(docs).columns[-2:] == ["sketch", "_sketch"]
    with pytest.raises(ValueError):
        sketch.limit_of(0.9)
