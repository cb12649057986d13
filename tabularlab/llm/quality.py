"""Quality rules as a short-circuit cascade.

Each rule rejects a document from one or two lazily computed text features.
On a sample of documents every rule is timed and its rejections are counted;
rules are then ordered by rejection per cost, and each document stops at the
first rule that rejects it.  The verdict is the conjunction of all rules, so
the measured order changes the cost only, never the result.

Defined cases: a null text has no words (all counts 0) and fails ``too_short``;
so does an empty text.  Repeated rows get the same verdict each.  Extra columns
pass through ``apply_rules`` unchanged; result columns whose name is taken get
a leading underscore.  Texts are processed whole, with memory linear in the
one text at hand.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularlab.llm.common import SPACE, free_name, need

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
SAMPLE_ROWS = 2000   # bound of the sample that the order is measured on
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by ``width``-word windows that occur twice or more, first occurrence included."""
    n = len(words)
    if n <= width:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    key, span = ids, len(index)
    for k in range(1, width):
        key = key[: n - k] * len(index) + ids[k:]
        span *= len(index)
        if span * len(index) >= 2**62:   # name the windows anew before the product overflows
            _, key = np.unique(key, return_inverse=True)
            span = len(key)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k: k + len(again)] |= again
    return int(covered.sum())


class Features:
    """Features of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_window_words(self.words)

    @cached_property
    def n_letters(self) -> int:
        return len(self.data) - len(self.data.translate(None, LETTERS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


BASE_RULES = (
    Rule("too_short", lambda f: f.n_words < 10),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 12 * f.n_words),
    Rule("capitals", lambda f: 2 * f.n_upper > f.n_letters),
)


def sample_texts(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` texts from the whole table, spread over all its files."""
    total = docs.count()   # answered from file metadata
    fraction = min(1.0, 1.2 * rows / total) if total else 1.0
    return docs.select(text).sample(fraction=fraction, seed=17).limit(rows)


def measure_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost in seconds and share rejected of each rule on a sample of at most
    ``sample_rows`` documents.  Each rule is timed on fresh features."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen += 1
                for i, rule in enumerate(rules):
                    f = Features(value)
                    start = time.perf_counter()
                    rejected[i] += rule.rejects(f)
                    spent[i] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "spent": spent,
                                          "rejected": rejected, "seen": [seen] * len(rules)})

    parts = sample_texts(docs, text, sample_rows).mapInArrow(measure, "rule long, spent double, rejected long, seen long")
    got = {r.rule: r for r in parts.groupBy("rule").agg(
        F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen")).collect()}
    out = []
    for i, rule in enumerate(rules):
        seen = got[i].seen if i in got else 0
        out.append({"rule": rule.name, "seconds": got[i].spent / seen if seen else 0.0,
                    "rejects": got[i].rejected / seen if seen else 0.0})
    return out


def cascade_order(rules, measured: list[dict]) -> list[Rule]:
    """Most rejection per second first; rules that reject nothing in the sample last, cheapest first."""
    rank = {m["rule"]: (-m["rejects"] / max(m["seconds"], 1e-9), m["seconds"]) for m in measured}
    return sorted(rules, key=lambda r: rank[r.name])


def apply_rules(docs: DataFrame, rules=RULES, order: list[Rule] | None = None, text: str = "text",
                report: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (boolean), and the features named in ``report``.

    ``kept`` comes from the cascade: rules run in ``order`` (measured on a
    sample when not given) and stop at the first rejection."""
    need(docs, text)
    order = order or cascade_order(rules, measure_rules(docs, rules, text))
    names = [free_name(docs, n) for n in (*report, "kept")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names[:-1]),
                           T.StructField(names[-1], T.BooleanType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in names]
            for value in batch.column(at).to_pylist():
                f = Features(value)
                made[-1].append(not any(rule.rejects(f) for rule in order))
                for column, name in zip(made, report):
                    column.append(getattr(f, name))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in made[:-1]), pa.array(made[-1], pa.bool_())],
                names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """The digest of ``op1_quality_rules``: base counts, ``base_failed`` and the cascade's verdict."""
    rows = apply_rules(docs.select("doc_id", "text"), report=FEATURES)
    # the text goes no further than the function: it is dropped right behind it
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", *FEATURES, failed.alias("base_failed"), "kept")


QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from d),
t as (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from w),
g as (select rid, i, concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) as s,
             lead(w, 4) over o as fifth from t window o as (partition by rid order by i)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as k from g where fifth is not null) where k > 1),
c as (select rid, count(*) as n_repeat_words from (select distinct rid, i + j as p from r, (select unnest(range(0, 5)) as j)) group by rid),
l as (select rid, unnest(ls) as l from w),
dl as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from l
       where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
f as (select d.doc_id, len(w.ws) as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(dl.n_dup_lines, 0) as n_dup_lines, coalesce(dl.n_lines, 0) as n_lines,
             coalesce(c.n_repeat_words, 0) as n_repeat_words,
             length(regexp_replace(d.text, '[^A-Z]', '', 'g')) as n_upper,
             length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) as n_letters
      from d join w using (rid) left join c using (rid) left join dl using (rid))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words
            or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 12 * n_words
            or 2 * n_upper > n_letters) as kept
from f
"""
