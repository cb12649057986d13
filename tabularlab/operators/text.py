"""Text operators (TX1-TX11, AG31, TK4).

Tokens are produced with JVM regex functions and exploded once; counts are
pre-aggregated per (document, token) in the map stage before any shuffle
(H9).  Fixed word lists are literal arrays / tiny broadcast tables.  Whole
texts are processed; nothing is truncated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.functions.arrays import pad_left, sliding_windows
from tabularlab.session import materialize, spread

# The stop-word list of the word-frequency report (as given, including its repeats).
STOP_WORDS = ['of', 'the', 'to', 'and', 'a', 'in', 'that', 'is', 'for', 'which', 'it', 'this', 'we', 'be', 'united',
              'on', 'by', 'as', 'have', 'has', 'nations', 'are', 'its', 'with', 'our', 'not', 'i', 'an', 'all', 'but',
              'or', 'my', 'they', 'was', 'should', 'those', 'one', 'their', 'will', 'other', 'one', 'can', 'also', 'must',
              'there', 'such', '', 'if', 'at', 'been', 'more', 'would', 'so', 'us', 'new', 'no', 'there', 'any',
              'against', 'who', 'only', 'may', 'from', 'many', 'than', 'his', '—']

WHITESPACE = r"(?U)\s"          # one split per whitespace character; empty tokens are kept
WORD = r"\p{L}+"                # letter runs, for indexers and vectors
BOW_TOKEN = r"[\p{L}\p{N}_]{2,}"  # word-character runs of length >= 2


def whitespace_tokens(text: Column) -> Column:
    """TX1: lower-case, split on every whitespace character (empty tokens count)."""
    return F.split(F.lower(text), WHITESPACE, -1)


def word_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased tokens matching ``pattern``."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def token_counts(df: DataFrame, keys: Sequence[str], tokens: Column, out: str = "token") -> DataFrame:
    """(keys, token, count): explode + grouped count; the map side combines
    repeated tokens of a document before the shuffle."""
    return spread(df).select(*keys, F.explode(tokens).alias(out)) \
        .groupBy(*keys, out).agg(F.count(F.lit(1)).alias("count"))


def tokenised(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, tokens), written once: everything that counts or encodes the corpus reads
    this table, so each text is tokenised a single time, spread over all tasks."""
    return materialize(spread(df, doc).select(doc, tokens.alias("tokens")), "tokens")


def counts_of(tokens: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, token, count) of a tokenised table."""
    return tokens.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("count"))


def remove_stop_words(counts: DataFrame, token: str = "token", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Anti join with the fixed stop list (a literal array: constant size)."""
    return counts.where(~F.col(token).isin(list(dict.fromkeys(stop_words))))


def top_words(df: DataFrame, group: str, text: str, k: int = 25,
              stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """TX2: per group the k most frequent whitespace tokens after stop-word
    removal, ordered by (count desc, token asc); ``rank`` 1..k."""
    c = remove_stop_words(token_counts(df, [group], whitespace_tokens(F.col(text))), "token", stop_words)
    w = Window.partitionBy(group).orderBy(F.col("count").desc(), F.col("token"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vocabulary_shift(top: DataFrame, group: str, a, b) -> DataFrame:
    """TX3: tokens in group a's top list and not in group b's (and the reverse).
    The top lists (k rows per group) are written once, so the corpus is not
    tokenised again for each side."""
    top = materialize(top.select(group, "token"), "top-words")
    ta = top.where(F.col(group) == a).select("token")
    tb = top.where(F.col(group) == b).select("token")
    return ta.subtract(tb).withColumn("kind", F.lit(f"only_{a}")).unionByName(
        tb.subtract(ta).withColumn("kind", F.lit(f"only_{b}")))


def keyword_trend(df: DataFrame, group: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """TX4: substring occurrences of each keyword summed per group, long form
    (group, keyword, n) with zeros kept."""
    import re
    cols = {f"cnt_{w}": F.sum(F.regexp_count(F.col(text), F.lit(re.escape(w)))).alias(f"cnt_{w}") for w in keywords}
    wide = df.groupBy(group).agg(*cols.values())
    long = wide.unpivot([group], list(cols), "keyword", "n")
    return long.withColumn("keyword", F.regexp_replace("keyword", "^cnt_", ""))


def fit_vocabulary(counts: DataFrame, token: str = "token", max_size: int | None = None,
                   min_count: int = 1) -> DataFrame:
    """TX5/TX6: (token, count, idx) with idx 1 = most frequent (ties: token asc).
    All tokens by default; ``max_size`` keeps the most frequent only (a top-k, so
    nothing else is numbered).  The numbering is a distributed row number (no
    single-partition window)."""
    from tabularlab.operators.order import top_k, with_row_number
    tot = counts.groupBy(token).agg(F.sum("count").alias("count")).where(F.col("count") >= min_count)
    order = [F.col("count").desc(), F.col(token)]
    return with_row_number(tot if max_size is None else top_k(tot, order, max_size), order, "idx")


def bag_of_words(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """TX5: (doc, token, count) restricted to a vocabulary (fit on train rows)."""
    return counts.join(vocab.select("token"), "token", "left_semi")


INDEX_BROADCAST_ROWS = 200_000    # vocabularies up to this size travel to the tokens


LOOKUP_ROWS = 4_000_000           # and, as hash and number (12 bytes each), larger ones that hold every token


def encode_sequences(tokens: DataFrame, doc: str, index: DataFrame, drop_unknown: bool = True,
                     unknown_id: int = 0, complete: bool = False) -> DataFrame:
    """TX6/TX9: each document's tokens replaced by their index, in text order:
    (doc, seq array<int>).  The per-document array holds one document.

    The index is broadcast when its counted size allows; beyond that both sides
    are shuffled and merged.  The exploded tokens are never broadcast.  An index that holds every
    token (``complete``) is looked up by hashes, counted to be distinct, and tokens are not exploded."""
    small = index.select("token", F.col("idx").cast("int").alias("idx"))
    rows = index.count()
    if complete and rows > INDEX_BROADCAST_ROWS:
        hashed = small.where(F.col("token").isNotNull()).select(F.xxhash64("token").alias("h"), "idx")
        told = hashed if drop_unknown else hashed.where(F.col("idx") != unknown_id)
        if told.count() <= LOOKUP_ROWS and hashed.count() == hashed.select("h").distinct().count():
            return _looked_up(tokens, doc, told, drop_unknown, unknown_id)
    toks = tokens.select(doc, F.posexplode("tokens").alias("pos", "token"))
    how = "inner" if drop_unknown else "left"
    small = F.broadcast(small) if rows <= INDEX_BROADCAST_ROWS else small.hint("merge")
    j = toks.join(small, "token", how).withColumn("idx", F.coalesce("idx", F.lit(unknown_id)))
    seq = j.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_s"))
    return seq.select(doc, F.transform("_s", lambda s: s["idx"]).alias("seq"))


def _looked_up(tokens: DataFrame, doc: str, told: DataFrame, drop_unknown: bool, unknown_id: int) -> DataFrame:
    """The same sequences by a table (h, idx) of hashes that travels to the tasks; only numbers are shuffled."""
    import numpy as np
    import pyarrow as pa
    held = told.toArrow()
    h, idx = held.column(0).to_numpy(), held.column(1).to_numpy()
    order = np.argsort(h)
    known = tokens.sparkSession.sparkContext.broadcast((h[order], idx[order]))

    def run(batches):
        h, idx = known.value
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(h, flat), max(len(h) - 1, 0))
            hit = h[at] == flat if len(h) else np.zeros(len(flat), bool)
            found = np.where(hit, idx[at], unknown_id).astype("i4") if len(h) else np.full(len(flat), unknown_id, "i4")
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype("i4")
            seq = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, mask=~hit if drop_unknown else None))
            yield pa.RecordBatch.from_arrays([b.column(0), seq], names=["doc", "seq"])

    kind = tokens.schema[doc].dataType.simpleString()
    rows = tokens.select(F.col(doc).alias("doc"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("t")) \
        .mapInArrow(run, f"doc {kind}, seq array<int>")
    # rows of one document are merged by position
    placed = F.flatten(F.transform("s", lambda one: F.transform(one, lambda x, i: F.struct(i.alias("pos"), x.alias("idx")))))
    merged = F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(F.transform(F.array_sort(placed), lambda x: x["idx"]))
    seq = F.filter(merged, lambda x: x.isNotNull()) if drop_unknown else merged
    return rows.groupBy("doc").agg(F.collect_list("seq").alias("s")).select(F.col("doc").alias(doc), seq.alias("seq")).where(F.size("seq") > 0)


def pad_sequences(seq: Column, length: int) -> Column:
    """TX7: keep the tail, left-pad with zeros to ``length``."""
    return pad_left(seq, length, 0)


def training_windows(df: DataFrame, doc: str, seq: str, length: int) -> DataFrame:
    """TX8: (doc, start, window, target) with target = the window one step later
    (null when it would cross the end of the document)."""
    # the sequence itself is not repeated beside each of its windows; a target is the next window
    pairs = F.transform(sliding_windows(F.col(seq), length + 1), lambda w: F.struct(
        F.slice(w, 1, length).alias("window"), F.slice(w, 2, length).alias("target")))
    n = F.size(F.col(seq))
    last = F.when(n >= length, F.array(F.struct(F.slice(F.col(seq), n - length + 1, length).alias("window"),
                                                F.lit(None).cast(df.schema[seq].dataType).alias("target"))))
    w = df.select(doc, F.posexplode(F.concat(pairs, last)).alias("start", "w"))
    return w.select(doc, (F.col("start") + 1).alias("start"), "w.window", "w.target")


def fold_rare_tokens(counts: DataFrame, max_count: int, token: str = "token") -> DataFrame:
    """TX9: tokens with count <= max_count get index 0; the rest dense ids by frequency."""
    tot = counts.groupBy(token).agg(F.sum("count").alias("count"))
    kept = fit_vocabulary(tot.where(F.col("count") > max_count), token)
    return tot.join(kept.select(token, "idx"), token, "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


def coverage_curve(counts: DataFrame, thresholds: int = 100, token: str = "token") -> DataFrame:
    """AG31: for t = 0..thresholds-1, share of the text and of the vocabulary kept
    when tokens with count <= t are dropped.  Works on the distribution of
    counts (one row per distinct count value), exploded by the thresholds."""
    tot = counts.groupBy(token).agg(F.sum("count").alias("c"))
    # one row per distinct count value (at most ~sqrt(2 x tokens) rows): written once
    # so the totals and the curve read it instead of counting the corpus again
    dist = materialize(tot.groupBy("c").agg(F.count(F.lit(1)).alias("n_tok"), F.sum("c").alias("occ")))
    all_tok = dist.agg(F.sum("n_tok")).scalar()
    all_occ = dist.agg(F.sum("occ")).scalar()
    x = dist.select("*", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("threshold"))
    g = x.groupBy("threshold").agg(F.sum(F.when(F.col("c") > F.col("threshold"), F.col("n_tok")).otherwise(0)).alias("_t"),
                                   F.sum(F.when(F.col("c") > F.col("threshold"), F.col("occ")).otherwise(0)).alias("_o"))
    return g.select("threshold", F.round(F.col("_o") / all_occ, 6).alias("text_share"),
                    F.round(F.col("_t") / all_tok, 6).alias("vocab_share"))
