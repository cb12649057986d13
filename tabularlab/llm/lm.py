"""Document log-probabilities from a subword lattice.

The lattice of a word holds every way to write it in pieces of an existing
vocabulary, and marginals come from a forward recursion in log space.  Pieces
never cross a blank, so a text's probability is the product of its words'
marginals and of the end's probability.  The vocabulary file is used as it is.
Its scores are every piece's prior: log-probabilities as they stand, merge ranks
by Zipf's law, 1 / (1 + rank).  The prior weighs ``PIECE_PRIOR`` counts a piece
against those of the file's own segmentation of the distinct training words; without
training words the prior alone weights the lattice.

A word seen in training has one more path, the whole word, weighted by its
discounted count; what the discount frees weights the paths through pieces:
P(w) = max(c - D, 0) / N + (D V / N) * M(w), with M the marginal over pieces and
D = n1 / (n1 + 2 n2) from the words seen once and twice.  This sums to at most 1.

Word counts cover all documents.  Each distinct word's lattice is solved once.
Words are joined to documents in two ways: a table of the most frequent words,
bounded by ``HOT_WORDS``, travels to every task and takes the hot keys; all others
go through a shuffled join, so any vocabulary size works.

Defined cases: a null text is empty and has the end token only.  A null doc_id
counts as the empty text for the split, so the row is held out.  Repeated rows
are counted and scored one by one.  With no training rows counts are zero and
both scores are still defined.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch, need

HOT_WORDS = 1 << 17        # bound of the word table that every task holds
FLUSH_WORDS = 400_000      # distinct words counted in a task before they are passed on
PIECE_PRIOR = 0.5          # counts that the prior weighs, a piece on average
UNSCORED = -1e8            # a file's score of this or less says that the piece has none
SMOOTH = 0.1               # of the word-level base model
LOG10 = math.log(10.0)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Pieces:
    """The vocabulary file's pieces and its own segmentation."""

    def __init__(self, path: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.byte_ids, self.ids = {}, {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and piece.count("▁") == piece.startswith("▁"):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids), default=1)

    def segment(self, words: list[str]) -> list[list[int]]:
        return self.processor.encode(words, num_threads=1)

    def prior(self) -> dict[int, float]:
        """Probability of every piece by the file's scores.  Bytes, and the blank alone, which files of merge
        ranks put below all others, have no score of their own: they get the least of the others."""
        score = {i: s for i in self.ids.values() if (s := self.processor.get_score(i)) > UNSCORED}
        if all(s <= 0 and s == int(s) for s in score.values()):
            mass = {i: 1.0 / (1.0 - s) for i, s in score.items()}
        else:
            mass = {i: math.exp(s) for i, s in score.items()}
        least = min(mass.values(), default=1.0)
        mass |= {i: least for i in [*self.byte_ids.values(), *self.ids.values()] if i not in mass}
        total = sum(mass.values())
        return {i: m / total for i, m in mass.items()}


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Marginal log-probability of words under piece log-weights."""

    def __init__(self, pieces: Pieces, log_weight: dict[int, float]):
        self.weight = {s: log_weight[i] for s, i in pieces.ids.items()}
        self.byte = {b: log_weight[i] for b, i in pieces.byte_ids.items()}
        self.longest = pieces.longest
        self.starts = {s[:k] for s in self.weight for k in range(1, len(s))}   # proper prefixes of pieces

    def log_marginal(self, word: str) -> float:
        """log of the summed weight of all segmentations of one word behind a blank."""
        text = "▁" + word
        weight, starts, n = self.weight, self.starts, len(text)
        alpha: list[list[float]] = [[] for _ in range(n + 1)]
        alpha[0].append(0.0)
        for i in range(n):
            into = alpha[i]
            if not into:
                continue
            alpha[i] = ()                      # only what lies ahead is kept
            a = into[0] if len(into) == 1 else log_sum(into)
            one = text[i]
            w = weight.get(one)
            if w is None:                      # a character outside the vocabulary is spelt in bytes
                w = sum(self.byte[b] for b in one.encode("utf-8", "surrogatepass"))
            alpha[i + 1].append(a + w)
            part, j = one, i + 1
            while part in starts and j < n:
                j += 1
                part = text[i:j]
                w = weight.get(part)
                if w is not None:
                    alpha[j].append(a + w)
        return log_sum(alpha[n])


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


# -- counting ---------------------------------------------------------------

def count_words(docs: DataFrame) -> DataFrame:
    """(word, train, total): counts in training documents and in all; the null word counts documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(train.keys() | held.keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array([None if k is None else k.decode("utf-8", "surrogatepass") for k in keys], pa.string()),
                 pa.array([train[k] for k in keys], pa.int64()),
                 pa.array([train[k] + held[k] for k in keys], pa.int64())], names=["word", "train", "total"])
            train.clear()
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                into = held if held_out(doc_id) else train
                into.update(words_of(text))
                into[None] += 1
                if len(train) + len(held) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, train long, total long")
    return rows.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def piece_weights(counts: DataFrame, path: str) -> dict[int, float]:
    """Log-weight per piece id, from the distinct training words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, found = load(path), Counter()
        for b in batches:
            for ids in pieces.segment(b.column(0).to_pylist()):
                found.update(ids)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    rows = counts.where("word is not null and train > 0").select("word").mapInArrow(run, "piece long, n long")
    n = {r.piece: r.n for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}   # at most one row per piece
    prior = load(path).prior()
    weight = PIECE_PRIOR * len(prior)
    total = sum(n.get(i, 0) for i in prior) + weight
    return {i: math.log((n.get(i, 0) + weight * p) / total) for i, p in prior.items()}


@dataclass(frozen=True)
class Mixture:
    """How whole words and pieces share the probability."""
    total: int         # training tokens, ends included
    distinct: int      # distinct training tokens, the end included
    discount: float

    @classmethod
    def of(cls, counts: DataFrame) -> "Mixture":
        r = counts.agg(F.sum("train"), *(F.count(F.when(F.col("train") >= k, 1)) for k in (1, 2, 3))).first()
        once, twice = r[1] - r[2], r[2] - r[3]
        return cls(r[0] or 0, r[1], once / (once + 2 * twice) if once and twice else 0.5)

    def log_pieces(self) -> float:
        return math.log(self.discount * self.distinct / self.total if self.total else 0.5)

    def log_whole(self, count: int) -> float | None:
        return math.log((count - self.discount) / self.total) if count else None

    def log_end(self, count: int) -> float:
        return self.log_whole(count) if count else math.log(0.5 if not self.total else self.discount / self.total)


def word_scores(counts: DataFrame, path: str, weights, mixture: Mixture) -> DataFrame:
    """(word, train, lp): the natural log of each word's marginal over all its paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, share = Lattice(load(path), weights.value), mixture.log_pieces()
        for b in batches:
            lp = []
            for word, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                through, whole = share + lattice.log_marginal(word), mixture.log_whole(count)
                lp.append(through if whole is None else log_sum([through, whole]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp, pa.float64())], names=["word", "train", "lp"])

    return counts.where("word is not null").select("word", "train").mapInArrow(run, "word string, train long, lp double")


def hot_threshold(counts: DataFrame, bound: int) -> int:
    """The smallest count such that at most ``bound`` words have it or more."""
    step = F.floor(F.log2("total") * 8)
    steps = counts.where("word is not null").groupBy(step.alias("s")).agg(
        F.count("*").alias("n"), F.min("total").alias("low")).orderBy(F.desc("s")).collect()   # a few hundred rows
    least, held = 1 << 62, 0
    for r in steps:
        held += r.n
        if held > bound:
            break
        least = r.low
    return least


def score_documents(docs: DataFrame, path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    with Scratch(spark, "lm") as scratch:
        counts = scratch.table(count_words(docs), "counts")
        mixture = Mixture.of(counts)
        ends = counts.where("word is null").agg(F.sum("train")).first()[0] or 0
        weights = spark.sparkContext.broadcast(piece_weights(counts, path))        # one number per piece of the vocabulary
        least = hot_threshold(counts, hot_words)
        hot_rows = word_scores(counts.where(F.col("total") >= least), path, weights, mixture).collect()   # at most hot_words rows
        hot = spark.sparkContext.broadcast({r.word.encode("utf-8", "surrogatepass"): (r.train, r.lp) for r in hot_rows})
        base_total = math.log10(mixture.total + SMOOTH * (mixture.distinct + 1))

        def base(c: int) -> float:
            return math.log10(c + SMOOTH) - base_total

        end_base, end_lp, end_known = base(ends), mixture.log_end(ends), int(ends > 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = {w: (base(c), lp, c > 0) for w, (c, lp) in hot.value.items()}
            rid = TaskContext.get().partitionId() << 40
            for b in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = words_of(text)
                    known, s, t, rare, times = end_known, end_base, end_lp, [], []
                    for w, k in Counter(words).items():
                        found = table.get(w)
                        if found is None:
                            rare.append(w.decode("utf-8", "surrogatepass"))
                            times.append(k)
                        else:
                            s += k * found[0]
                            t += k * found[1]
                            known += k * found[2]
                    rows.append((rid, held_out(doc_id), len(words) + 1, known, s, t, rare, times))
                    rid += 1
                c = list(zip(*rows)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), b.column(0), pa.array(c[1], pa.bool_()), pa.array(c[2], pa.int64()),
                     pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.float64()),
                     pa.array(c[6], pa.list_(pa.string())), pa.array(c[7], pa.list_(pa.int64()))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "known", "s", "t", "rare", "times"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        parts = scratch.table(docs.select("doc_id", "text").mapInArrow(
            run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, s double, t double, "
                 "rare array<string>, times array<long>"), "parts")
        # what the bounded table does not hold is joined on the word; none of these words is frequent
        rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")) \
            .select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
        cold = word_scores(counts.where(F.col("total") < least), path, weights, mixture)
        word_base = F.log10(F.col("train") + SMOOTH) - F.lit(base_total)
        sums = rare.join(cold, "word").groupBy("rid").agg(
            F.sum(F.col("k") * word_base).alias("rs"), F.sum(F.col("k") * F.col("lp")).alias("rt"),
            F.sum(F.when(F.col("train") > 0, F.col("k")).otherwise(0)).alias("rk"))
        out = parts.drop("rare", "times").join(sums, "rid", "left")
        zero = F.lit(0.0)
        return scratch.table(out.select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rk", F.lit(0))).alias("n_known"),
            F.lit(mixture.total).cast("bigint").alias("train_tokens"),
            (F.col("s") + F.coalesce("rs", zero)).alias("base_score"),
            ((F.col("t") + F.coalesce("rt", zero)) / LOG10).alias("score")), "result", keep=True)
