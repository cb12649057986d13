import random

import cases
import pytest
from pyspark.sql import functions as F

from tabularlab.llm import linededup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def by_length(n):
    """Edits that lines of n characters or more may differ in, with ``SHORT_EDITS``."""
    return 2 if n >= 25 else 1 if n >= 12 else 0


def brute(rows, allowed=lambda n: 2 if n >= 50 else 0):
    """Rows equal in id and text are one document; the shorter line of a pair sets the edits allowed."""
    out, seen = {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[i, text] = None
            continue
        stay = []
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                near = any(line == o or (abs(len(line) - len(o)) <= (most := allowed(min(len(line), len(o)))) and edits(line, o) <= most)
                           for o in seen)
                seen.append(line)
                if near:
                    continue
            stay.append(line)
        out[i, text] = "\n".join(stay)
    return out


def mutated(rng, line, most):
    line = list(line)
    for _ in range(rng.randint(0, most)):
        at, how = rng.randrange(len(line)), rng.random()
        if how < 0.33:
            line.insert(at, rng.choice("abcdé"))
        elif how < 0.66 and len(line) > 2:
            line.pop(at)
        else:
            line[at] = rng.choice("abcdé")
    return "".join(line)


@pytest.mark.parametrize("max_edits", [1, 2, 3])
def test_bit_parallel_distance(spark, max_edits):
    rng, pairs = random.Random(max_edits), []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(3, 14)))
        x, y = sorted((a, mutated(rng, a, max_edits + 2)), key=len)
        if len(y) - len(x) <= max_edits and x != y:
            pairs.append((x, y))
    line = lambda c: F.struct(F.col(c).alias("line"), F.length(c).alias("n"), F.transform(
        F.split(F.col(c), ""), lambda k: F.ascii(k)).alias("codes")).alias("s" + c)
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line("x"), line("y")) \
        .select("x", "y", linededup.within_edits(F.col("sx"), F.col("sy"), max_edits).alias("near")).collect()
    assert [(r.x, r.y) for r in got if r.near != (edits(r.x, r.y) <= max_edits)] == []


@pytest.mark.parametrize("block_lines, keys", [(48, 500_000), (2, 500_000), (48, 0)])
def test_equals_brute_force(spark, monkeypatch, block_lines, keys):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", keys)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(49, 70))) for _ in range(25)]
    rows = [(i, "\n".join(mutated(rng, rng.choice(base), 3) if rng.random() < 0.7 else rng.choice(["", "  ", "short line", "x"])
                          for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), block_lines=block_lines).collect()
    want = brute(rows)
    assert {r.doc_id: r.text for r in got} == {i: t for (i, _), t in want.items()}
    lost = {i: t.count("\n") - want[i, t].count("\n") for i, t in rows if want[i, t]}
    assert {r.doc_id: r.n_dropped for r in got if r.doc_id in lost} == lost


def brute_by_length(rows):
    """The shorter line of a pair decides: 1 edit from 12 characters, 2 from 25."""
    out, seen = {}, []
    for i, text in sorted(rows):
        stay = []
        for line in text.split("\n"):
            near = False
            for o in seen:
                n = min(len(line), len(o))
                allowed = by_length(n)
                near = near or line == o or (abs(len(line) - len(o)) <= allowed and edits(line, o) <= allowed)
            seen.append(line)
            if not near:
                stay.append(line)
        out[i] = "\n".join(stay)
    return out


@pytest.mark.parametrize("block_lines, keys", [(48, 500_000), (2, 0)])
def test_short_lines_equal_brute_force(spark, monkeypatch, block_lines, keys):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", keys)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in [*range(9, 32)] * 2 + [48, 49, 50, 51, 52]]
    rows = [(i, "\n".join(mutated(rng, rng.choice(base), 3) for _ in range(rng.randint(1, 8)))) for i in range(110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.drop_lines(docs, block_lines=block_lines, short=linededup.SHORT_EDITS).collect()}
    assert got == brute_by_length(rows)


def test_query_and_stage_drop_short_near_lines(spark, tmp_path):
    import corpus_pipeline
    from tabularlab.llm import queries
    pair = ["Thwhesnd, esator whshing and hewh.", "Thwhesnd esator whshing and hewh."]
    docs = spark.createDataFrame([(i, f"{t}\n{cases.GOOD if i else cases.OTHER}", "en", "a", 9) for i, t in enumerate(pair)], cases.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [f"{pair[0]}\n{cases.OTHER}", cases.GOOD]
    assert [r.text for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()] == want
    assert [r.text for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_awkward_rows(spark):
    rows = [r for r in cases.rows() if r[1] is None or len(r[1]) < 4000]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = linededup.drop_lines(docs).collect()
    want = brute([(r[0], r[1]) for r in rows])
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r[0], want[r[0], r[1]]) for r in rows), key=repr)


def test_long_text_clashing_columns_and_empty_table(spark):
    docs = cases.crowded(spark)
    out = linededup.drop_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"] and out.count() == docs.count()
    assert linededup.drop_lines(cases.empty(spark)).count() == 0


def test_near_equal_long_text(spark):
    text = cases.near_equal_text(400)     # several blocks under one key
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want, seen = [], []
    for line in text.split("\n"):
        def near(o):
            at = next((k for k, (p, q) in enumerate(zip(line, o)) if p != q), min(len(line), len(o)))
            x, y = line[at:][::-1], o[at:][::-1]
            at = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            return abs(len(x) - len(y)) <= 2 and edits(x[at:], y[at:]) <= 2
        if not any(near(o) for o in seen):
            want.append(line)
        seen.append(line)
    for short in ((), linededup.SHORT_EDITS):
        assert linededup.drop_lines(docs, short=short).first().text.split("\n") == want


def test_main_path_has_no_python(spark):
    plan = linededup.drop_lines(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_of_single_bytes_are_cut_as_bytes(spark, monkeypatch):
    """Their keys are those of the characters, so they meet lines with longer characters, which are cut as before."""
    cut, segment_keys = [], linededup.segment_keys
    monkeypatch.setattr(linededup, "segment_keys", lambda line, *a: cut.append("binary" in str(line).lower()) or segment_keys(line, *a))
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=n)) for n in (11, 12, 13, 24, 25, 26, 27, 28, 29, 49, 50, 51, 52, 80, 300)]
    rows = [(i, line) for i, line in enumerate(base)]
    rows += [(100 + i, line[:at] + "é" + line[at + 1:]) for i, line in enumerate(base) for at in (i % len(line),)]
    rows += [(200 + i, line[:3] + "z" + line[3:]) for i, line in enumerate(base)]
    rows += [(300 + i, "日" + line[1:-1] + "€") for i, line in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_lines(docs, short=linededup.SHORT_EDITS)
    assert {(r.doc_id, t): r.text for r in got.collect() for t in [dict(rows)[r.doc_id]]} == brute(rows, by_length)
    assert True in cut and False in cut
    line = spark.createDataFrame([(x,) for x in base[8:]], "line string").withColumn("n", F.length("line"))
    keys = [segment_keys(c, F.col("n"), linededup.edit_rule(2, 50, linededup.SHORT_EDITS))[1] for c in (F.col("line"), F.col("line").cast("binary"))]
    for a, b in line.select(*keys).collect():
        assert a == b and len(a) == 12
