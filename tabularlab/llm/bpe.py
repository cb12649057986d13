"""Byte-pair encoding and decoding as a bounded-lookahead streaming transducer.

The merge list fixes how far to the right a decision can depend on: a merge of
rank r needs its right token, and that token's right edge can only be taken
away by a merge of lower rank, whose own right token can be taken in turn.
``lookahead`` is the longest such chain, in symbols.  A word (a match of the
tokenizer's pre-token pattern; merges never cross it) is read through a buffer:
what lies further than the lookahead from the buffer's end is final and is
emitted, and since no merge crosses a final boundary the rest starts anew there.
Memory is the buffer, however long the word.  Words recur, so finished words
are kept in a table of bounded size.

Decoding is a state machine over ids.  It follows the tokenizer file's decoder:
none (token strings joined by a blank, as the library does) or byte level
(bytes go through an incremental UTF-8 decoder that holds a partial character).

Normalising and pre-token splitting use Python's tables for characters on which
they equal the tokenizer library's (``PLAIN``), and the library's own
components for any other text, so that results do not depend on Unicode versions.

Defined cases: a null text counts as empty: no tokens and the digests of
nothing.  Special-token strings inside a text become their ids, as in the
library.  Repeated rows give equal results.  Extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularlab.llm.common import need

# Characters on which Python's Unicode tables and the tokenizer library's agree (tests compare them).
PLAIN = "\\x00-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u3040-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
NOT_PLAIN = regex.compile(f"[^{PLAIN}]")
CHUNK_CHARS = 1 << 20     # texts are walked in pieces of about this many characters
CACHE_WORDS = 300_000     # finished words kept per Python worker
BUFFER = 512              # symbols read ahead of the lookahead when a word is long
RUN_IDS = 1 << 14         # ids decoded at once


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes themselves, the others from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], lengths: dict[str, int]) -> int:
    """Symbols to the right that can decide whether a boundary is final."""
    made: dict[str, list[str]] = {}      # token -> right parts of the merges that make it

    def right_edge(token: str) -> set[str]:
        edge, todo = set(), [token]
        while todo:
            t = todo.pop()
            if t not in edge:
                edge.add(t)
                todo += made.get(t, ())
        return edge

    reach: dict[str, int] = {}           # token -> furthest reach of the merges so far that start with it
    for left, right in merges:
        need = lengths[right] + max(reach.get(t, 0) for t in right_edge(right) | {right})
        reach[left] = max(reach.get(left, 0), need)
        made.setdefault(left + right, []).append(right)
    return max(reach.values(), default=0)


class Bpe:
    """Encoder and decoder for one tokenizer file with a BPE model over byte characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.order = [self.vocab[a + b] for a, b in pairs]
        self.pair_rank = {p: r for p, (r, _) in self.rank.items()}
        length = {t: len(t.removesuffix(self.suffix) if self.suffix else t) for t in self.vocab}
        self.lookahead = lookahead(pairs, length)
        alphabet = byte_alphabet()
        self.plain = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        any_special = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.special_split = regex.compile(f"({any_special})") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.normalised = spec.get("normalizer") is not None
        splits = [s for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"]
        self.pattern = splits[0]["pattern"]["Regex"] if splits else None
        if self.pattern is None:
            raise ValueError("the file's pre-tokenizer has no split pattern")
        self.words = regex.compile(self.pattern)
        self.path, self._library = path, None
        self.cache: dict[str, bytes] = {}     # stretches between blanks
        self.finished: dict[str, tuple[int, ...]] = {}      # words

    # -- words ------------------------------------------------------------

    def library(self):
        if self._library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers
            self._library = (Tokenizer.from_file(self.path).normalizer,
                             pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True))
        return self._library

    def pieces(self, text: str) -> Iterable[str]:
        """Normalised pre-tokens of a text without special tokens."""
        if NOT_PLAIN.search(text):
            normalizer, split = self.library()
            return [p for p, _ in split.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)]
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:   # character by character: no rule for a final sigma
            text = text.replace("Σ", "σ").lower()
        if text.isalpha():
            return (text,)
        return (m.group() for m in self.words.finditer(text))

    # -- merging ----------------------------------------------------------

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of one buffer: lowest rank first, then leftmost."""
        rank = self.rank
        if len(ids) <= 64:
            order, pair_rank, none = self.order, self.pair_rank, len(self.order)
            ranks = [pair_rank.get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                ids[i: i + 2] = [order[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = pair_rank.get((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = pair_rank.get((ids[i], ids[i + 1]), none)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, new, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or rank.get((ids[i], ids[j])) != (r, new):
                continue
            ids[i], gone[j], after[i] = new, True, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (new, ids[after[i]])) in rank:
                    heapq.heappush(heap, (*rank[p], i))
            if before[i] >= 0 and (p := (ids[before[i]], new)) in rank:
                heapq.heappush(heap, (*rank[p], before[i]))
        return [x for x, g in zip(ids, gone) if not g]

    def length(self, i: int) -> int:
        t = self.token[i]
        return len(t.removesuffix(self.suffix)) if self.suffix else len(t)

    def word_ids(self, word: str) -> Iterable[int]:
        if len(word) > 64:
            return self.transduce(word)
        got = self.finished.get(word)
        if got is None:
            got = tuple(self.transduce(word))
            keep(self.finished, word, got)
        return got

    def transduce(self, word: str) -> Iterator[int]:
        """Ids of one pre-token, emitted as soon as they are final."""
        data = word.encode("utf-8", "surrogatepass")
        window = self.lookahead + BUFFER
        at = 0
        while len(data) - at > window:
            stop = at + BUFFER
            for i in self.merged([self.plain[b] for b in data[at: at + window]]):
                end = at + self.length(i)
                if end > stop:
                    break
                yield i
                at = end
            else:
                raise AssertionError("no final token inside the buffer")
        rest = data[at:]
        yield from self.merged([*(self.plain[b] for b in rest[:-1]), self.last[rest[-1]]])

    def blank_free(self, text: str) -> Iterator[int]:
        """Ids of a stretch of text: special tokens first, then words."""
        for part in self.special_split.split(text) if self.special_split else (text,):
            if part in self.special:
                yield self.special[part]
            else:
                for word in self.pieces(part):
                    yield from self.word_ids(word)

    # -- texts ------------------------------------------------------------

    def walk(self, text: str) -> Iterator[bytes]:
        """Per chunk of text: its ids as little-endian 32-bit words.  Pre-tokens never contain a blank or line feed."""
        cache = self.cache
        for chunk in chunks(text):
            keys = chunk.replace("\n", " ").split(" ")
            packed = [cache.get(k) for k in keys]
            if None in packed:
                for at, key in enumerate(keys):
                    if packed[at] is None:
                        packed[at] = cache.get(key) or self.stretch(key)
            yield b"".join(packed)

    def stretch(self, key: str) -> bytes:
        ids = list(self.blank_free(key))
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(key) <= 64:
            keep(self.cache, key, got)
        return got

    def encode(self, text: str) -> list[int]:
        return [i for packed in self.walk(text) for (i,) in struct.iter_unpack("<I", packed)]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of the decoded text, one per run of ids, each emitted as soon as it is known."""
        token = self.token.__getitem__
        ids = iter(ids)
        runs = iter(lambda: list(islice(ids, RUN_IDS)), [])
        if self.decoder == "ByteLevel":
            state, byte_of = codecs.getincrementaldecoder("utf-8")("replace"), self.byte_of.__getitem__
            for run in runs:
                yield state.decode(bytes(map(byte_of, "".join(map(token, run)))))
            yield state.decode(b"", True)
        else:
            between = ""
            for run in runs:
                yield between + " ".join(map(token, run))
                between = " "

    def readable(self, ids: Iterable[int]) -> Iterator[str]:
        """Words as a reader sees them: byte characters back to text, a blank after each word end."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            t = self.token[i]
            if i in self.special.values():
                yield state.decode(b"", True) + t + " "
                continue
            end = bool(self.suffix) and t.endswith(self.suffix)
            data = bytes(self.byte_of[c] for c in (t.removesuffix(self.suffix) if end else t))
            yield state.decode(data) + (" " if end else "")
        yield state.decode(b"", True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, sha256 of the ids, sha256 of the decoded text), in one pass."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0

        def emitted() -> Iterator[tuple[int, ...]]:
            nonlocal n
            for packed in self.walk(text):
                ids.update(packed)
                n += len(packed) // 4
                yield struct.unpack(f"<{len(packed) // 4}I", packed)

        for piece in self.decode(chain.from_iterable(emitted())):
            decoded.update(piece.encode("utf-8"))
        return n, ids.hexdigest(), decoded.hexdigest()


def keep(cache: dict, key, value) -> None:
    """Add to a table of bounded size; when full, its older half goes."""
    if len(cache) >= CACHE_WORDS:
        for k in list(islice(cache, CACHE_WORDS // 2)):
            del cache[k]
    cache[key] = value


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in pieces that end at a blank or line feed."""
    at = 0
    while len(text) - at > size:
        cuts = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
        if not cuts:
            break
        yield text[at: min(cuts)]
        at = min(cuts) + 1
    yield text[at:]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    need(docs, id_col, text)
    slim = docs.select(F.col(id_col), F.col(text).alias("_text"))
    schema = T.StructType([slim.schema.fields[0], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            made = [bpe.digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())],
                names=schema.names)

    return slim.mapInArrow(run, schema)


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text as an array<int> column."""
    need(docs, text)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            made = pa.array([bpe.encode(t or "") for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_column(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded", readable: bool = False) -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids give a null text."""
    need(rows, ids)
    at = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        step = bpe.readable if readable else bpe.decode
        for b in batches:
            made = pa.array([None if x is None else "".join(step(x)) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)

    return rows.mapInArrow(run, schema)
