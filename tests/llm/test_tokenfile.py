import random
import struct
import zlib

import cases
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tabularlab.llm import tokenfile
from tabularlab.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_report_equals_the_library(spark, library):
    rows = [(r[0], r[1]) for r in cases.rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in tokenfile.token_file_report(docs, PATH).collect()]
    assert sorted(got) == sorted(expected(library, rows))


def test_null_ids_come_last_and_nothing_is_lost(spark):
    got = tokenfile.token_file_report(cases.crowded(spark), PATH).orderBy("start").collect()
    assert [r.doc_id for r in got][-2:] == [None, None] and len(got) == len(cases.rows())
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert tokenfile.token_file_report(cases.empty(spark), PATH).count() == 0


def test_any_white_space(library):
    code, rng = tokenfile.Stretches(PATH), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "　", "a", "the", "é", "1", "23", "!", "'s", ".", "<|endoftext|>", "中", "́",
             " b", " Word", " x,", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text, got in zip(texts, code.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), text


def test_file_format_and_selective_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(4000)], "doc_id long, text string")
    out = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(docs, out, PATH, 2)
    part = tokenfile.read_tokens(spark, out, 100, 120)
    assert sorted(r.doc_id for r in part.collect()) == list(range(100, 121))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan
    counts = tokenfile.read_counts(spark, out)
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    files = [pq.ParquetFile(f) for f in (tmp_path / "tokens").glob("*.parquet")]
    column = {c.path_in_schema: c for f in files for g in range(f.num_row_groups) for c in
              (f.metadata.row_group(g).column(i) for i in range(f.metadata.num_columns))}
    ids = next(c for n, c in column.items() if n.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    assert column["doc_id"].has_offset_index and column["doc_id"].has_column_index


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_STRETCHES", 50)
    code = tokenfile.Stretches(PATH)
    for i in range(20):
        code.encode([" ".join(f"w{i}x{j}" for j in range(40))])
    assert len(code.known) <= 90


def test_new_stretches_go_to_the_library_joined_and_words_once(library):
    """Thousands of new stretches are a few texts for the library, whose results are large; a mark makes no new stretch."""
    code, rng, asked = tokenfile.Stretches(PATH), random.Random(4), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    code.library = Counting()
    words = ["".join(rng.choice("abcdeé9") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [rng.choice([" ", "\n", ". "]).join(rng.sample(words, 200)) + rng.choice(["", ".", "\n", "?!", "\0"]) for _ in range(60)]
    for text, got in zip(texts, code.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), text
    assert len(asked) < 200
    before = len(code.known)
    code.encode([f"{words[0]} {w}{m}" for w in words[:500] if w[-1] != "é" for m in tokenfile.MARKS])
    assert len(code.known) - before <= 600


def test_rows_go_to_python_by_bytes(spark):
    """Batches are bounded by bytes, not by ten thousand rows, and the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with tokenfile.small_batches(spark):
        assert int(spark.conf.get(name)) == tokenfile.BATCH_BYTES < 8 << 20
    assert spark.conf.get(name) == before
