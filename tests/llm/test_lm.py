import itertools
import math
from collections import Counter

import cases
import pytest

from tabularlab.llm import lm
from tabularlab.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


def all_segmentations(word, weight):
    """Brute force: the summed probability of every way to cut the word in known pieces."""
    total, text = 0.0, "▁" + word
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at, pieces = 0, []
        for i, cut in enumerate(cuts, 1):
            if cut:
                pieces.append(text[at:i])
                at = i
        pieces.append(text[at:])
        if all(p in weight for p in pieces):
            total += math.exp(sum(weight[p] for p in pieces))
    return total


@pytest.fixture(scope="module")
def lattice():
    pieces = lm.load(PATH)
    ids = [*pieces.ids.values(), *pieces.byte_ids.values()]
    return lm.Lattice(pieces, {i: math.log((1 + i % 13) / (8.0 * len(ids))) for i in ids})


def test_marginal_sums_all_segmentations(lattice):
    for word in ("a", "the", "thereof", "undoing", "naïve", "x1!y"):
        assert math.exp(lattice.log_marginal(word)) == pytest.approx(all_segmentations(word, lattice.weight), rel=1e-9)


def test_unknown_characters_are_spelt_in_bytes_and_long_words_do_not_underflow(lattice):
    assert "ⵣ" not in lattice.weight
    want = lattice.weight["▁"] + sum(lattice.byte[b] for b in "ⵣ".encode())
    assert lattice.log_marginal("ⵣ") == pytest.approx(want)
    assert -1e6 < lattice.log_marginal("ab" * 5000) < -1000


@pytest.mark.parametrize("hot", [lm.HOT_WORDS, 3, 0])
def test_scores_equal_direct_sums(spark, hot):
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = lm.score_documents(cases.crowded(spark), PATH, hot_words=hot).collect()
    c = Counter()
    for i, text in rows:
        if not lm.held_out(i):
            c.update(lm.words_of(text))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    seen = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    want = []
    for i, text in rows:
        tokens = [*lm.words_of(text), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((repr(i), lm.held_out(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6)))
    assert seen == sorted(want)
    whole = {(repr(r.doc_id), r.n_tokens): r.score for r in lm.score_documents(cases.documents(spark), PATH).collect()}
    assert all(r.score == pytest.approx(whole[repr(r.doc_id), r.n_tokens], rel=1e-9) and r.score < 0 for r in got)


def brute_prior(pieces):
    """Zipf's law on the merge ranks, for this file."""
    ranks = {i: -pieces.processor.get_score(i) for i in pieces.ids.values()}
    mass = {i: 1 / (1 + r) for i, r in ranks.items() if r < 1e8}
    mass |= {i: min(mass.values()) for i in [*pieces.byte_ids.values(), *ranks] if i not in mass}
    total = math.fsum(mass.values())
    return {i: m / total for i, m in mass.items()}


@pytest.mark.parametrize("hot", [lm.HOT_WORDS, 5])
def test_score_equals_the_sum_over_all_segmentations_of_whole_documents(spark, hot):
    rows = [(r[0], r[1]) for r in cases.rows() if max(map(len, (r[1] or "").split()), default=0) <= 13]
    assert len(rows) > 12 and any("中文字" in (t or "") for _, t in rows)
    docs = spark.createDataFrame([*rows, (31, "naïve ⵣ x1!y")], "doc_id long, text string")
    rows.append((31, "naïve ⵣ x1!y"))
    pieces, count = lm.load(PATH), Counter()
    for i, text in rows:
        if not lm.held_out(i):
            count.update(w.decode() for w in lm.words_of(text))
            count[None] += 1
    words = [w for w in count if w is not None]
    found = Counter(i for ids in pieces.processor.encode(words) for i in ids)
    prior, n = brute_prior(pieces), sum(count.values())
    strength = 0.5 * len(prior)
    total = sum(found[k] for k in prior) + strength
    p = {i: (found[i] + strength * q) / total for i, q in prior.items()}
    weight = {s: math.log(p[i]) for s, i in pieces.ids.items()}

    def every_way(word):
        spelt = {c: math.fsum(math.log(p[pieces.byte_ids[b]]) for b in c.encode()) for c in word if c not in weight}
        return all_segmentations(word, weight | spelt)

    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5

    def probability(word):
        if word is None:                       # the end is no word: it has its own path only
            return max(count[None] - d, 0) / n
        return max(count[word] - d, 0) / n + d * len(count) / n * every_way(word)

    known = {w: math.log10(probability(w)) for w in {w.decode() for _, t in rows for w in lm.words_of(t)} | {None}}
    want = sorted((repr(i), round(sum(known[w] for w in [*(x.decode() for x in lm.words_of(t)), None]), 6)) for i, t in rows)
    got = sorted((repr(r.doc_id), round(r.score, 6)) for r in lm.score_documents(docs, PATH, hot_words=hot).collect())
    assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in want]


def test_prior_follows_the_scores():
    pieces = lm.load(PATH)
    prior = pieces.prior()
    assert math.fsum(prior.values()) == pytest.approx(1) and prior == pytest.approx(brute_prior(pieces))
    by_score = sorted((i for i in pieces.ids.values() if pieces.processor.get_score(i) > -1e8), key=pieces.processor.get_score)
    assert all(prior[a] < prior[b] for a, b in zip(by_score, by_score[1:]))

    class LogProbabilities:
        """Scores as a unigram file has them."""
        ids, byte_ids = {"▁a": 0, "b": 1, "c": 2}, {65: 3}
        processor = type("P", (), {"get_score": staticmethod([-0.5, -1.5, -2.25, 0.0].__getitem__)})

    got = lm.Pieces.prior(LogProbabilities)
    assert got[0] / got[1] == pytest.approx(math.e) and got[3] == got[2]


def test_word_probabilities_sum_to_at_most_one(spark):
    with_words = lm.Mixture(total=100, distinct=30, discount=0.6)
    counts = [10] * 7 + [1] * 20 + [5] * 2     # 29 words and the end, 100 tokens
    assert sum(math.exp(with_words.log_whole(c)) for c in counts) + math.exp(with_words.log_end(0)) < 1
    assert sum(counts) + 0 == 100 and math.exp(with_words.log_pieces()) == pytest.approx(0.18)


def test_held_out_text_of_the_language_scores_above_noise(spark):
    rows = [(i, cases.GOOD if i % 2 else cases.OTHER) for i in range(60)]
    held = next(i for i in range(1000, 2000) if lm.held_out(i))
    other = next(i for i in range(held + 1, 3000) if lm.held_out(i))
    docs = spark.createDataFrame([*rows, (held, cases.GOOD), (other, " ".join("zqxj" for _ in cases.GOOD.split()))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(docs, PATH).collect()}
    assert got[held] > got[other]


def test_no_training_rows_and_empty_table(spark):
    held = next(i for i in range(1000) if lm.held_out(i))
    row, = lm.score_documents(spark.createDataFrame([(held, "some words")], "doc_id long, text string"), PATH).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score) and row.base_score == 0.0
    assert lm.score_documents(cases.empty(spark), PATH).count() == 0
