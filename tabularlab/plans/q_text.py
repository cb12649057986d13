"""Text queries over ``documents`` (periods := lang) and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.operators import text as TX
from tabularlab.plans.catalog import register
from tabularlab.session import materialize
from tabularlab.sources.tables import Tables

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(TX.STOP_WORDS)) + ")"
WS_TOKENS_SQL = "unnest(regexp_split_to_array(lower(text), '\\s'))"
WORDS_SQL = "regexp_extract_all(lower(text), '\\p{L}+')"
BOW_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@register("tx1_word_count", "select doc_id, len(regexp_split_to_array(lower(text), '\\s')) as word_count from documents")
def tx1(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", TX.word_count(F.col("text")).cast("bigint").alias("word_count"))


TOP_WORDS_SQL = f"""
with t as (select lang, {WS_TOKENS_SQL} as token from documents),
c as (select lang, token, count(*) as count from t where token not in {STOP_SQL} group by lang, token),
r as (select *, row_number() over (partition by lang order by count desc, token) as rank from c)
select lang, token, count, rank from r where rank <= 25"""


@register("tx2_top_words_by_period", TOP_WORDS_SQL)
def tx2(spark, sf):
    return TX.top_words(Tables(spark, sf).documents, "lang", "text", 25).withColumn("rank", F.col("rank").cast("bigint"))


@register("tx3_vocabulary_shift", f"""
with top as ({TOP_WORDS_SQL})
select token, 'only_en' as kind from (select token from top where lang = 'en' except select token from top where lang = 'fr')
union all
select token, 'only_fr' from (select token from top where lang = 'fr' except select token from top where lang = 'en')""")
def tx3(spark, sf):
    return TX.vocabulary_shift(tx2(spark, sf), "lang", "en", "fr")


KEYWORDS = ["the", "and", "les", "der", "que"]


@register("tx4_keyword_trend", " union all ".join(
    f"select lang, '{w}' as keyword, cast(sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)}) as bigint) as n "
    f"from documents group by lang" for w in KEYWORDS))
def tx4(spark, sf):
    return TX.keyword_trend(Tables(spark, sf).documents, "lang", "text", KEYWORDS)


BOW_VOCAB_SQL = f"select distinct unnest({BOW_SQL}) as token from documents where doc_id % 5 <> 0"


def _tokens(d, pattern=TX.WORD):
    return TX.tokenised(d, "doc_id", TX.words(F.col("text"), pattern))


@register("tx5_bag_of_words", f"""
with v as ({BOW_VOCAB_SQL}),
t as (select doc_id, unnest({BOW_SQL}) as token from documents)
select doc_id, token, count(*) as count from t where token in (select token from v) group by doc_id, token""")
def tx5(spark, sf):
    # counted once per document; the vocabulary is every token of the train rows
    counts = materialize(TX.counts_of(TX.spread(Tables(spark, sf).documents, "doc_id").select(
        "doc_id", TX.words(F.col("text"), TX.BOW_TOKEN).alias("tokens")), ["doc_id"]), "bag")
    vocab = counts.where(F.col("doc_id") % 5 != 0).select("token").distinct()
    return TX.bag_of_words(counts, vocab).select("doc_id", "token", "count")


INDEX_SQL = f"""
with t as (select unnest({WORDS_SQL}) as token from documents),
c as (select token, count(*) as count from t group by token)
select token, count, row_number() over (order by count desc, token) as idx from c"""

SEQ_SQL = f"""
with ix as ({INDEX_SQL}),
t as (select doc_id, unnest({WORDS_SQL}) as token, unnest(generate_series(1, len({WORDS_SQL}))) as pos from documents)
select doc_id, string_agg(cast(ix.idx as varchar), ',' order by pos) as seq, count(*) as seq_len
from t join ix on t.token = ix.token group by doc_id"""


def _index(d):
    return TX.fit_vocabulary(TX.counts_of(_tokens(d)))


def _sequences(d):
    tokens = _tokens(d)
    return TX.encode_sequences(tokens, "doc_id", TX.fit_vocabulary(TX.counts_of(tokens)), complete=True)


@register("tx6_token_index", INDEX_SQL)
def tx6(spark, sf):
    return _index(Tables(spark, sf).documents).select("token", "count", "idx")


@register("tx6_encoded_sequences", SEQ_SQL)
def tx6s(spark, sf):
    s = _sequences(Tables(spark, sf).documents)
    return s.select("doc_id", F.array_join("seq", ",").alias("seq"), F.size("seq").cast("bigint").alias("seq_len"))


PAD = 2000       # length of a padded sequence


@register("tx7_pad_sequences", f"""
with s as (select doc_id, string_split(seq, ',') as a from ({SEQ_SQL}))
select doc_id, array_to_string(case when len(a) >= {PAD} then a[len(a) - {PAD - 1}:]
                                    else list_concat(list_transform(range({PAD} - len(a)), lambda x: '0'), a) end, ',') as padded
from s""")
def tx7(spark, sf):
    s = _sequences(Tables(spark, sf).documents)
    return s.select("doc_id", F.array_join(TX.pad_sequences(F.col("seq"), PAD), ",").alias("padded"))


FOLD_SQL = f"""
with t as (select unnest({WORDS_SQL}) as token from documents),
c as (select token, count(*) as count from t group by token),
k as (select token, row_number() over (order by count desc, token) as idx from c where count > 2)
select c.token, c.count, coalesce(k.idx, 0) as idx from c left join k on c.token = k.token"""


@register("tx9_fold_rare_tokens", FOLD_SQL)
def tx9(spark, sf):
    return TX.fold_rare_tokens(TX.counts_of(_tokens(Tables(spark, sf).documents)), 2).select("token", "count", "idx")


WINDOW = 5


@register("tx8_training_windows", f"""
with ix as ({FOLD_SQL}),
t as (select doc_id, unnest({WORDS_SQL}) as token, unnest(generate_series(1, len({WORDS_SQL}))) as pos from documents),
s as (select doc_id, list(ix.idx order by pos) as seq from t join ix on t.token = ix.token group by doc_id),
w as (select doc_id, seq, unnest(generate_series(1, len(seq) - {WINDOW - 1})) as start from s where len(seq) >= {WINDOW})
select doc_id, cast(start as int) as start, array_to_string(seq[start:start + {WINDOW - 1}], ',') as window,
       case when start + {WINDOW} <= len(seq) then array_to_string(seq[start + 1:start + {WINDOW}], ',') end as target
from w""")
def tx8(spark, sf):
    tokens = _tokens(Tables(spark, sf).documents)
    idx = materialize(TX.fold_rare_tokens(TX.counts_of(tokens), 2), "folded")
    seqs = TX.encode_sequences(tokens, "doc_id", idx, drop_unknown=False, complete=True)
    w = TX.training_windows(seqs, "doc_id", "seq", WINDOW)
    return w.select("doc_id", "start", F.array_join("window", ",").alias("window"), F.array_join("target", ",").alias("target"))


def vector_table(t: Tables, idx):
    """Word vectors: the embedding with vec_id = r - 1 belongs to the word of
    frequency rank r.  ASCII words are stored upper-case, so the lookup must
    ignore case (other scripts keep their case: their case mappings differ
    between engines and are not invertible, e.g. sharp s)."""
    stored = F.when(F.col("token").rlike("^[a-z]+$"), F.upper("token")).otherwise(F.col("token"))
    return t.embeddings.join(idx, F.col("vec_id") == F.col("idx") - 1).select(stored.alias("vt_token"), "embedding")


@register("tx10_vector_coverage", f"""
with ix as ({INDEX_SQL}),
vt as (select case when regexp_matches(ix.token, '^[a-z]+$') then upper(ix.token) else ix.token end as vt_token
       from embeddings e join ix on e.vec_id = ix.idx - 1)
select count(*) as vocab_size, count(vt_token) as n_matched,
       round(1 - count(vt_token) / count(*), 6) as oov_vocab_share,
       round(sum(case when vt_token is null then count else 0 end) / sum(count), 6) as oov_text_share
from ix left join vt on lower(vt.vt_token) = ix.token""")
def tx10(spark, sf):
    t = Tables(spark, sf)
    counts = materialize(_index(t.documents), "index")       # one row per token, with its count
    vt = vector_table(t, counts)
    j = counts.join(vt, F.lower(F.col("vt_token")) == F.col("token"), "left")
    return j.agg(F.count(F.lit(1)).alias("vocab_size"), F.count("vt_token").alias("n_matched"),
                 F.round(1 - F.count("vt_token") / F.count(F.lit(1)), 6).alias("oov_vocab_share"),
                 F.round(F.sum(F.when(F.col("vt_token").isNull(), F.col("count")).otherwise(0)) / F.sum("count"), 6)
                 .alias("oov_text_share"))


@register("tx10_vector_lookup")
def tx10l(spark, sf):
    """Vectors for every token; out-of-vocabulary tokens get a seeded random
    vector (hash of token and position), so reruns agree."""
    t = Tables(spark, sf)
    counts = materialize(_index(t.documents), "index")       # one row per token, with its count
    vt = vector_table(t, counts)
    j = counts.join(vt, F.lower(F.col("vt_token")) == F.col("token"), "left")
    rnd = F.transform(F.sequence(F.lit(1), F.lit(64)),
                      lambda i: (F.pmod(F.xxhash64(F.col("token"), i), F.lit(1 << 20)) / float(1 << 20) - 0.5)
                      .cast("float"))
    return j.select("token", F.coalesce(F.col("embedding"), rnd).alias("vector"),
                    F.col("embedding").isNull().alias("random"))


@register("tx11_word2vec")
def tx11(spark, sf):
    from pyspark.ml.functions import array_to_vector

    from tabularlab.operators import word_vectors as WV
    vectors = WV.skip_gram_vectors(_tokens(Tables(spark, sf).documents), rank=100, epochs=5)
    return vectors.select("word", array_to_vector("vector").alias("vector"))


PAIRS_SQL = f"""
t as (select doc_id, unnest({WORDS_SQL}) as w, unnest(generate_series(1, len({WORDS_SQL}))) as i from documents),
v as (select w from t group by w having count(*) >= 5),
d as (select a.w as word, b.w as context from t a join t b on a.doc_id = b.doc_id and b.i - a.i between -5 and 5 and a.i <> b.i),
p as (select word, context, count(*) as n from d where word in (select w from v) and context in (select w from v) group by all)"""


@register("tx11_cooccurrence", f"""
with {PAIRS_SQL},
s as (select word, sum(n) as nw from p group by word)
select p.word, p.context, p.n, round(ln(cast(p.n as double) * (select sum(n) from p) / (cast(a.nw as double) * b.nw)), 6) as ppmi
from p join s a on p.word = a.word join s b on p.context = b.word
where ln(cast(p.n as double) * (select sum(n) from p) / (cast(a.nw as double) * b.nw)) > 0""")
def tx11c(spark, sf):
    from tabularlab.operators import word_vectors as WV
    tokens = _tokens(Tables(spark, sf).documents)
    return WV.weighted_pairs(tokens).withColumn("ppmi", F.round("ppmi", 6))


@register("tx11_factor_vectors")
def tx11f(spark, sf):
    """Vectors of the frequent words, and of all others by their n-grams."""
    from tabularlab.operators import word_vectors as WV
    tokens = _tokens(Tables(spark, sf).documents)
    vectors = materialize(WV.factor_vectors(WV.weighted_pairs(tokens)), "vectors")
    grams = materialize(WV.gram_vectors(vectors), "grams")
    return WV.vectors_for(tokens.select(F.explode("tokens").alias("word")), vectors, grams)


@register("ag31_token_coverage", f"""
with t as (select unnest({WORDS_SQL}) as token from documents),
c as (select token, count(*) as c from t group by token),
th as (select unnest(range(0, 100)) as threshold)
select threshold, round(sum(case when c > threshold then c else 0 end) / (select sum(c) from c), 6) as text_share,
       round(count(*) filter (where c > threshold) / (select count(*) from c), 6) as vocab_share
from c, th group by threshold""")
def ag31(spark, sf):
    return TX.coverage_curve(TX.counts_of(_tokens(Tables(spark, sf).documents)), 100) \
        .withColumn("threshold", F.col("threshold").cast("bigint"))


@register("tk4_most_common_words", f"""
select token, count(*) as count from (select {WS_TOKENS_SQL} as token from documents)
where token not in {STOP_SQL} group by token order by count desc, token limit 25""")
def tk4(spark, sf):
    from tabularlab.operators.order import top_k
    c = TX.remove_stop_words(TX.token_counts(Tables(spark, sf).documents, [], TX.whitespace_tokens(F.col("text"))))
    return top_k(c, [F.col("count").desc(), "token"], 25)
