import re
from collections import Counter

import cases
from tabularlab.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stats = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    base = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    other = (10 * stats[2] > stats[0] or 2 * stats[3] > len(lines) or not 2 * stats[0] <= stats[1] <= 12 * stats[0]
             or 2 * upper > letters)
    return (*stats, base, not (base or other))


def test_report_equals_brute_force(spark):
    got = sorted((tuple(r) for r in quality.quality_report(cases.documents(spark)).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in cases.rows()), key=repr)


def test_order_does_not_change_the_verdict(spark):
    docs = cases.crowded(spark)
    one = quality.apply_rules(docs, order=list(quality.RULES)).select("doc_id", "_kept").collect()
    two = quality.apply_rules(docs, order=list(reversed(quality.RULES))).select("doc_id", "_kept").collect()
    assert one == two and docs.columns == quality.apply_rules(docs).columns[:-1]


def test_cascade_puts_cheap_rejecting_rules_first():
    rules = [quality.Rule(n, lambda f: False) for n in "abc"]
    measured = [{"rule": "a", "seconds": 1.0, "rejects": 0.5}, {"rule": "b", "seconds": 0.1, "rejects": 0.2},
                {"rule": "c", "seconds": 0.01, "rejects": 0.0}]
    assert [r.name for r in quality.cascade_order(rules, measured)] == ["b", "a", "c"]


def test_cascade_stops_at_the_first_rejection(spark):
    def never(f):
        raise AssertionError("must not run")
    rules = [quality.Rule("all", lambda f: True), quality.Rule("never", never)]
    assert quality.apply_rules(cases.documents(spark), order=rules).where("kept").count() == 0


def test_empty_table(spark):
    assert quality.quality_report(cases.empty(spark)).count() == 0


def test_window_names_do_not_overflow():
    words = [b"w%d" % i for i in range(9000)]
    assert quality.repeated_window_words(words + words[:7]) == 14
    assert quality.repeated_window_words(words) == 0
