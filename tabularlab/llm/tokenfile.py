"""Token ids as Parquet files in document order, for selective reads.

Files hold one row per document: ``part`` (the file's place in the order),
``row`` (the document's place in the file), doc_id, n_tokens and ``ids``
(list<int>).  Ids are dictionary encoded (a vocabulary's ids fit one
dictionary page per row group), the counters delta encoded; row groups and
pages have set sizes and page indexes, so a read of some documents or of the
counters alone touches only those pages.

Documents are dealt by ranges of doc_id (ties by text hash, then by position,
so no range is bound to one key), sorted in each range and encoded there.
Encoding looks up the distinct stretches between single blanks and line feeds of some texts in a bounded
table; new stretches go to the tokenizers library, many joined to one text, whose ids are
dealt back by their tokens' bytes.  A cut at a single blank between two other characters
never changes the library's pre-tokens, nor does one at a single line feed there, or one between a letter
or digit and a mark that ends the stretch: stretches are looked up without it.

Defined cases: a null text counts as empty and is written with the end id
alone.  Null doc_ids come last.  Repeated rows are written as often as they
occur, next to each other.  Only doc_id and text are read.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch, need

CACHE_STRETCHES = 500_000       # encoded stretches kept per Python worker
JOINED = 512                    # new stretches that the library gets as one text
BATCH_BYTES = 4 << 20           # of rows that go to Python at once
# white space beside blanks and line feeds; the mark that cuts are made at
ODD = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"] + ["\0"]
ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
MARKS = ".,;:!?"                # after a letter or digit each starts a pre-token of its own
WRITE_OPTIONS = {
    "parquet.block.size": str(32 << 20),             # bytes of a row group
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",          # documents in a page, for selective reads
    "parquet.writer.version": "PARQUET_2_0",         # delta encodings; column and offset indexes
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#row": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


class Stretches:
    """Ids of texts, by looking up the stretches between single blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # the task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}       # what was asked for since the last change of tables
        self.older: dict[str, bytes] = {}       # the table before
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        self.marks = np.full(256, -1, np.int64)     # their ids
        for m, ids in zip(MARKS, self.learn_alone(list(MARKS))):
            if len(ids) == 4 and all([p for p, _ in pieces(c + m)] == [c, m] for c in "a1"):
                self.marks[ord(m)] = int.from_bytes(ids, "little")
        self.size = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)      # bytes of each id
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)         # a character of the byte alphabet each
        for i, token in self.library.get_added_tokens_decoder().items():
            self.size[i] = len(token.content.encode())

    def learn(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch.  Those that a text can hold after one another are joined."""
        join = [len(s) > 1 and s[0] in " \n" and not s[1].isspace() and not s[-1].isspace() for s in stretches]
        joined, out = [s for s, j in zip(stretches, join) if j], []
        for at in range(0, len(joined), JOINED):
            out += self.learn_joined(joined[at: at + JOINED])
        alone = iter(self.learn_alone([s for s, j in zip(stretches, join) if not j]))
        together = iter(out)
        return [next(together if j else alone) for j in join]

    def learn_alone(self, stretches: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(stretches), JOINED):
            made = self.library.encode_batch_fast(stretches[at: at + JOINED], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in made]
        return out

    def learn_joined(self, stretches: list[str]) -> list[bytes]:
        ids = np.array(self.library.encode_batch_fast(["".join(stretches)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(s.encode()) for s in stretches])
        reached = np.cumsum(self.size[ids])
        at = np.searchsorted(reached, ends)
        if len(ids) == 0 or reached[-1] != ends[-1] or (reached[at] != ends).any():      # ids that do not stand for the bytes
            return self.learn_alone(stretches)
        packed, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
        return [packed[a:z] for a, z in zip([0, *cuts], cuts)]

    @staticmethod
    def plain(text: str) -> bool:
        """Whether every blank stands alone between two other characters."""
        return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in ODD))

    @classmethod
    def marked(cls, text: str) -> str:
        """The text with a zero before each stretch but the first; those start with a blank or line feed that stands alone."""
        if not cls.plain(text):
            return "\0".join(cls.cut(text))
        text = text.replace(" ", "\0 ")
        return text if "\n\n" in text else text.replace("\n", "\0\n")

    @staticmethod
    def cut(text: str) -> list[str]:
        out, open_, first = [], "", True
        for part in text.split(" "):
            joined = part if first else " " + part
            # a blank next to other white space belongs to that run: no cut there
            if first or part == "" or part[0].isspace() or open_ == "" or open_[-1].isspace():
                open_ += joined
            else:
                out.append(open_)
                open_ = joined
            first = False
        out.append(open_)
        return out

    def looked_up(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches."""
        if len(self.known) > CACHE_STRETCHES // 2:
            self.known, self.older = {}, self.known
        known = self.known
        missing = [s for s, ids in zip(stretches, map(known.get, stretches)) if ids is None]
        again = {s: ids for s, ids in zip(missing, map(self.older.get, missing)) if ids is not None}
        known.update(again)
        new = [s for s in missing if s not in again]
        known.update(zip(new, self.learn(new)))
        found = list(map(known.__getitem__, stretches))
        for s in new:
            if len(s) > 64:
                del known[s]
        return found

    def unmarked(self, stretches: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """(stretches without a last mark that follows an ASCII letter or digit, the mark's id or -1)."""
        _, offsets, data = stretches.buffers()
        offsets, data = np.frombuffer(offsets, np.int64)[:len(stretches) + 1], np.frombuffer(data or b"", np.uint8)
        ends = offsets[1:]
        some = np.flatnonzero(np.diff(offsets) > 2)
        some = some[(self.marks[data[ends[some] - 1]] >= 0) & ALNUM[data[ends[some] - 2]]]
        mark = np.full(len(stretches), -1, np.int64)
        mark[some] = self.marks[data[ends[some] - 1]]
        data = np.delete(data[:offsets[-1]], ends[some] - 1)
        offsets = offsets - np.concatenate([[0], np.cumsum(mark >= 0)])
        return pa.LargeStringArray.from_buffers(len(stretches), pa.py_buffer(offsets), pa.py_buffer(data)), mark

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode_all(texts)
        packed, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [packed[a:z] for a, z in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after one another, how many each has)."""
        cuts = pc.split_pattern(pa.array([self.marked(t) if "\0" not in t else "" for t in texts], pa.large_string()), "\0")
        offsets = cuts.offsets.to_numpy()
        coded = cuts.flatten().dictionary_encode()
        del cuts
        words, mark = self.unmarked(coded.dictionary)
        words = words.dictionary_encode()
        ids, start, size = ragged(self.looked_up(words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        # of each distinct stretch, with its mark, then of each stretch
        word = words.indices.to_numpy()
        ids, start, size = taken(ids, start[word], size[word], (mark >= 0).astype(np.int64))
        ids[(start + size - 1)[mark >= 0]] = mark[mark >= 0]
        code = coded.indices.to_numpy()
        whole = [i for i, t in enumerate(texts) if "\0" in t]
        if whole:       # texts that hold the zero: their one stretch here is empty
            more, at, n = ragged(self.learn_alone([texts[i] for i in whole]))
            code = code.copy()
            code[offsets[whole]] = np.arange(len(start), len(start) + len(whole))
            ids, start, size = np.concatenate([ids, more]), np.concatenate([start, at + len(ids)]), np.concatenate([size, n])
        ids, start, size = taken(ids, start[code], size[code])
        after = np.append(start, len(ids))[offsets]
        return ids, np.diff(after)


def ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all parts, where each starts, how many it has)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, size


def taken(ids: np.ndarray, start: np.ndarray, size: np.ndarray, room: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts at ``start`` after one another, with room behind each."""
    out = size + room
    to = np.cumsum(out) - out
    if isinstance(room, int):
        return ids[np.repeat(start - to, size) + np.arange(size.sum())], to, out
    made = np.zeros(int(out.sum()), "<u4")
    first = np.cumsum(size) - size
    step = np.arange(size.sum())
    made[np.repeat(to - first, size) + step] = ids[np.repeat(start - first, size) + step]
    return made, to, out


@lru_cache(maxsize=2)
def load(path: str) -> Stretches:
    return Stretches(path)


def groups(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) of about ``size`` bytes together, so that memory is bounded."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // size
    starts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(texts)]]).tolist()
    for a, z in zip(starts, starts[1:]):
        if a < z:
            yield a, [t or "" for t in texts.slice(a, z - a).to_pylist()]


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text",
                 options: dict[str, str] = WRITE_OPTIONS) -> None:
    """Write the ids of all documents to the folder ``out`` in ascending id order."""
    need(docs, id_col, text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"),
                       F.monotonically_increasing_id().alias("m"), F.col(text).alias("t"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("m")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, row = load(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for at, texts in groups(b.column(1)):
                ids, counts = code.encode_all(texts)
                ends = np.cumsum(counts)
                sizes = counts + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.insert(ids, ends, end_id).view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(texts), part, np.int64)), pa.array(np.arange(row, row + len(texts))),
                     b.column(0).slice(at, len(texts)), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(offsets), values)],
                    names=["part", "row", "doc_id", "n_tokens", "ids"])
                row += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    sorted_.mapInArrow(run, f"part long, row long, doc_id {kind}, n_tokens long, ids array<int>") \
        .write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, out: str, low=None, high=None) -> DataFrame:
    """Documents of the files with low <= doc_id <= high; row groups and pages outside are skipped."""
    rows = spark.read.parquet(out)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """(part, row, doc_id, n_tokens): no page of ids is read."""
    return spark.read.parquet(out).select("part", "row", "doc_id", "n_tokens")


def with_starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``start``: the ids of all documents before.  Totals are kept per file
    (one row each), running sums stay inside a file."""
    spark = rows.sparkSession
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offset, firsts = 0, []
    for r in totals:
        firsts.append((r.part, offset))
        offset += r.n
    first = spark.createDataFrame(firsts, "part long, first long")
    before = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(first, "part") \
        .withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("first")


def with_checksums(rows: DataFrame) -> DataFrame:
    """(part, row, doc_id, n_tokens, ids_crc32), counted and summed over the ids that were read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            packed = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            crc = [zlib.crc32(packed[4 * a: 4 * z]) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("part", "row", "doc_id", "ids") \
        .mapInArrow(run, f"part long, row long, doc_id {kind}, n_tokens long, ids_crc32 long")


@contextmanager
def small_batches(spark: SparkSession):
    """Rows go to Python by ``BATCH_BYTES`` while this holds, whatever their length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def token_file_report(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the token files, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    with Scratch(spark, "tokens") as scratch, small_batches(spark):
        out = scratch.path("files")
        scratch.paths.append(out)
        write_tokens(docs, out, path, end_id)
        read = scratch.table(with_checksums(read_tokens(spark, out)), "read")
        return scratch.table(with_starts(read, scratch).select("doc_id", "start", "n_tokens", "ids_crc32"), "result", keep=True)
