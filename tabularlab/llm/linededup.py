"""Line dedup across documents, by exact repetition and by a segment-partition edit join.

A line goes when an equal line, or one within the edits allowed, stands
earlier; order is by doc_id, then line number.  Lines without a word always
stay.  Pairs whose shorter line has ``min_chars`` code points or more may differ
by ``max_edits`` edits; ``short`` lists (code points from, edits) for shorter ones,
and what is shorter still is compared exactly only.

Exact repetition is one aggregation of 128-bit line hashes (no line text is
shuffled).  For the edit join a line of m characters that allows e edits is cut in e + 1
segments: a partner within e edits has one of them unchanged, at a place
that its length and the segment's number narrow down to a few starts.  So each
line emits one hashed key per such substring, for partners of its own length and
of each shorter length allowed; keys that only one line has are dropped by an
aggregation, and lines that share a key are verified with a banded bit-parallel
automaton (one bit per diagonal and one word per number of edits).

Lines that share a key are gathered in blocks of about ``block_lines``, and blocks
meet pairwise inside one row each, so a key that many lines share is spread over
many tasks and no pair of lines ever becomes a row.

Defined cases: a null text has no lines and stays null.  A null doc_id comes after
all others.  Rows equal in doc_id and text are one document: their lines stay
or go together.  Two rows with one doc_id that have the same line in the same
place tie, and both keep it.  A text whose lines all stay is unchanged; a text
that loses all its lines becomes empty.  Input columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularlab.llm.common import SPACE_CLASS, Scratch, free_name, let, need

MAX_EDITS = 2
MIN_CHARS = 50
SHORT_EDITS = ((12, 1), (25, 2))     # in lines under 12 characters an edit is mostly another word or number
BLOCK_LINES = 48
BROADCAST_KEYS = 500_000     # shared keys (8 bytes each) up to which they are broadcast
LAST_ID = (1 << 63) - 1
PLACE = "decimal(38,0)"

Rule = tuple[tuple[int, int], ...]     # (code points from, edits), rising: the shorter line of a pair decides


def edit_rule(max_edits: int, min_chars: int, short: Rule = ()) -> Rule:
    rule = []
    for chars, edits in (*(r for r in sorted(short) if r[0] < min_chars), (min_chars, max_edits)):
        if not rule or rule[-1][1] != edits:
            rule.append((chars, edits))
    return tuple(rule)


def by_length(length: Column, rule: Rule, value) -> Column:
    """value(edits) for the edits that a line of this length allows; null below the rule's first length."""
    (_, edits), *longer = rule
    out = value(edits)
    for chars, edits in longer:
        out = F.when(length >= chars, value(edits)).otherwise(out)
    return F.when(length >= rule[0][0], out)


def place(doc_id: Column, pos: Column) -> Column:
    """Order of a line as one number, so that a minimum needs no sort."""
    return doc_id.cast(PLACE) * F.lit(1 << 32).cast("decimal(10,0)") + pos.cast(PLACE)


def line_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, row, pos, line) of every line with a word.  ``row`` names the document by its content."""
    doc_id = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID))
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("row"),
                       F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line")) \
        .where(F.col("line").rlike(f"[^{SPACE_CLASS}]"))


def hash1(line: Column) -> Column:
    return F.xxhash64(line)


def hash2(line: Column) -> Column:
    return F.xxhash64(F.lit("second"), line)


def segment_starts(max_edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment number, shift) of the substrings that can equal a partner's segment."""
    out = []
    for less in range(max_edits + 1):
        for i in range(1, max_edits + 2):
            low = max(-(i - 1), less - (max_edits + 1 - i))
            high = min(i - 1, less + max_edits + 1 - i)
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def segment_bounds(length: Column, i: int | Column, edits: int | Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line with ``length`` characters."""
    cut = lambda k: F.floor(length * k / (edits + 1)).cast("int")
    return cut(i - 1), cut(i) - cut(i - 1)


def segment_keys(line: Column, length: Column, rule: Rule) -> tuple[int, Column, Column | None]:
    """(from, array for lines of that many characters, array for shorter ones) of struct<key, own, seg>:
    hashed substrings; ``own`` marks a line's own segments."""
    def key(less, i, shift, edits, own) -> Column:
        start, size = segment_bounds(length - less, i, edits)
        return F.struct(F.xxhash64(length - less, i if isinstance(i, Column) else F.lit(i), F.substring(line, start + shift + 1, size))
                        .alias("key"), (own if isinstance(own, Column) else F.lit(own)).alias("own"),
                        (i if isinstance(i, Column) else F.lit(i)).alias("seg"))

    def places(chars: int) -> list[tuple[int, int, int, int, bool]]:
        """(shorter by, segment, shift, edits, own) for lines of this length: a partner's length says how it is cut."""
        out = []
        for less in range(most + 1):
            edits = max((e for c, e in rule if c <= chars - less), default=-1)
            out += [(*p, edits, p[0] == 0 and p[2] == 0) for p in segment_starts(max(edits, 0)) if p[0] == less <= edits]
        return out

    most = max(e for _, e in rule)
    if len(rule) == 1:     # places for partners under the first length find nothing
        return rule[0][0], F.array(*(key(*p) for p in places(rule[0][0] + most))), None
    first, *rest = sorted({c + less for c, _ in rule for less in range(most + 1)}, reverse=True)
    names, shorter = ("less", "i", "shift", "edits", "own"), None
    for chars in reversed(rest):
        table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p))) for p in places(chars)))
        shorter = table if shorter is None else F.when(length >= chars, table).otherwise(shorter)
    return first, F.array(*(key(*p) for p in places(first))), F.transform(shorter, lambda p: key(*(p[n] for n in names)))


def common_prefix(x: Column, y: Column, longest: Column) -> Column:
    """Characters (up to ``longest``) that two strings share at their start, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(17))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= longest) & (F.substring(x, at + 1, step) == F.substring(y, at + 1, step)), at + step).otherwise(at))


def within_edits(x: Column, y: Column, max_edits: int) -> Column:
    """Whether two lines (structs of ``line``, ``n`` and ``codes``; x no longer than y) are within ``max_edits`` edits.

    After j characters of y, bit d of word k says that the first j + d - max_edits
    characters of x can be reached with k edits.  A match or a substitution stays on
    the diagonal d, an insertion moves one down, a deletion one up.  The walk starts
    behind the common prefix and stops for good once no bit is left."""
    wide = 2 * max_edits + 1
    words = [f"r{k}" for k in range(max_edits + 1)]
    start = F.struct(*(F.lit(sum(1 << (max_edits + i) for i in range(k + 1))).alias(w) for k, w in enumerate(words)))

    def step(acc: Column, j: Column) -> Column:
        def word(k: int, made: list[Column], match: Column) -> Column:
            if k > max_edits:
                return F.struct(*(m.alias(w) for m, w in zip(made, words)))
            got = acc[words[k]].bitwiseAND(match)
            if k:
                below = acc[words[k - 1]]
                up = F.shiftleft(made[-1], 1).bitwiseAND(F.lit((1 << wide) - 1))
                got = got.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(up)
            return let(got, lambda v: word(k + 1, [*made, v], match))

        def match_of(c: Column) -> Column:
            return sum((F.when(F.get(x["codes"], j + (d - max_edits - 1)) == c, 1 << d).otherwise(0) for d in range(wide)), F.lit(0))

        return F.when(acc[words[-1]] == 0, acc).otherwise(
            let(F.get(y["codes"], j - 1), lambda c: let(match_of(c), lambda m: word(0, [], m))))

    def walk(state: Column, first: Column, last: Column) -> Column:
        return F.when(first > last, state).otherwise(F.aggregate(F.sequence(first, F.greatest(first, last)), state, step))

    def verdict(state: Column) -> Column:
        final = F.call_function("shiftright", state[words[-1]], x["n"] - y["n"] + max_edits)
        return final.bitwiseAND(F.lit(1)) == 1

    def from_prefix(p: Column) -> Column:
        # most pairs end within a few characters of their first difference
        soon = F.least(p + 8 * (max_edits + 1), y["n"])
        return let(walk(start, p + 1, soon), lambda s: F.when(s[words[-1]] == 0, F.lit(False)).otherwise(
            verdict(walk(s, soon + 1, y["n"]))))

    return let(common_prefix(x["line"], y["line"], x["n"]), from_prefix)


def near_lines(lines: DataFrame, scratch: Scratch, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
               block_lines: int = BLOCK_LINES, short: Rule = ()) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within the edits allowed."""
    rule = edit_rule(max_edits, min_chars, short)
    sized = lines.withColumn("n", F.length("line"))
    first, keys, shorter = segment_keys(F.col("line"), F.col("n"), rule)

    def keyed(some: DataFrame, k: Column) -> DataFrame:
        return some.select("line", "n", place(F.col("doc_id"), F.col("pos")).alias("at"), hash1(F.col("line")).alias("h1"),
                           k.alias("k")).select("line", "n", "at", "h1", "k.key", "k.own", "k.seg")

    # lines of single bytes are cut as bytes, which gives the same keys: a substring of characters walks the line from its start
    plain = (F.col("n") >= first) & (F.octet_length("line") == F.col("n"))
    long = keyed(sized.where(plain), F.explode(segment_keys(F.col("line").cast("binary"), F.col("n"), rule)[1]))
    # none of these arrays is empty; were empty ones to be left out, Spark would compute the keys once more as a filter
    others = keys if shorter is None else F.when(F.col("n") >= first, keys).otherwise(shorter)
    long = long.unionByName(keyed(sized.where((F.col("n") >= rule[0][0]) & ~plain), F.explode_outer(others)))
    # a key matters if two different lines have it, one of them as a segment of its own
    shared = scratch.table(long.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.max("own").alias("own"))
                           .where("a <> b and own").select("key"), "shared")
    by_line = ["key", "seg", "h1", "h2", "n"]
    if shared.count() <= BROADCAST_KEYS:
        hits = long.join(F.broadcast(shared), "key").withColumn("h2", hash2(F.col("line")))
        found = hits.groupBy(*by_line).agg(F.min("at").alias("at"), F.max("own").alias("own"), F.first("line").alias("line"))
    else:     # without the texts, which follow for the lines that share a key
        hits = scratch.table(long.withColumn("h2", hash2(F.col("line"))).drop("line").join(shared, "key")
                             .groupBy(*by_line).agg(F.min("at").alias("at"), F.max("own").alias("own")), "hits")
        texts = lines.withColumn("h1", hash1(F.col("line"))).withColumn("h2", hash2(F.col("line"))) \
            .join(hits.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi") \
            .groupBy("h1", "h2").agg(F.first("line").alias("line"))
        found = hits.join(texts, ["h1", "h2"])
    found = scratch.table(found, "found")
    sizes = found.groupBy("key").agg(F.ceil(F.count("*") / block_lines).cast("int").alias("blocks"))
    codes = F.transform(F.split(F.col("line"), ""), lambda c: F.ascii(c))
    blocks = scratch.table(
        found.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("h2", F.lit(3)), F.col("blocks")).cast("int"))
        .select("key", "seg", "block", F.struct("h1", "h2", "at", "n", "own", "line", codes.alias("codes")).alias("l"))
        .groupBy("key", "seg", "block").agg(F.collect_list("l").alias("ls")), "blocks")

    def meets(x: Column, y: Column, seg: Column) -> Column:
        """x is an own-segment line, no longer than y, and the two are within reach."""
        def within(edits: int) -> Column:
            covered = F.lit(False)     # the pair also meets at an earlier segment: it is verified there
            for i in range(1, edits + 1):
                start, size = segment_bounds(x["n"], i, edits)
                covered = covered | ((seg > i) & (x["n"] == y["n"])
                                     & (F.substring(x["line"], start + 1, size) == F.substring(y["line"], start + 1, size)))
            return (y["n"] - x["n"] <= edits) & ~covered & within_edits(x, y, edits)

        return x["own"] & (x["n"] <= y["n"]) & by_length(x["n"], rule, within)

    def later_of(left: Column, right: Column, seg: Column) -> Column:
        """Lines of ``right`` that come after a line of ``left`` they meet."""
        return F.filter(right, lambda y: F.exists(left, lambda x: (x["at"] < y["at"]) & F.when(
            (x["n"] < y["n"]) | ((x["n"] == y["n"]) & x["own"]), meets(x, y, seg)).otherwise(meets(y, x, seg))))

    one = blocks.select("key", "seg", F.col("block").alias("b1"), F.col("ls").alias("left"))
    two = blocks.select("key", F.col("block").alias("b2"), F.col("ls").alias("right"))
    # both orders of two blocks: each row looks for the later lines of its right block
    later = one.join(two, "key").select(F.explode(later_of(F.col("left"), F.col("right"), F.col("seg"))).alias("l"))
    return scratch.table(later.select("l.h1", "l.h2").distinct(), "near")


def lines_to_drop(docs: DataFrame, scratch: Scratch, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
                  id_col: str = "doc_id", text: str = "text", block_lines: int = BLOCK_LINES, short: Rule = ()) -> DataFrame:
    """(doc_id, row, drop): the line numbers that go, per document that loses any."""
    lines = line_rows(docs, id_col, text)
    slim = scratch.table(lines.select("doc_id", "row", "pos", hash1(F.col("line")).alias("h1"),
                                      hash2(F.col("line")).alias("h2")), "lines")
    near = near_lines(lines, scratch, max_edits, min_chars, block_lines, short).withColumn("all", F.lit(True))
    at = place(F.col("doc_id"), F.col("pos"))
    first = slim.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("times"))
    # lines that occur once and have no near line cannot go: they take no part in the join
    decide = first.join(near, ["h1", "h2"], "left").where("times > 1 or all").select("h1", "h2", "first", "all")
    gone = slim.join(decide, ["h1", "h2"]).where(F.col("all") | (at != F.col("first")))
    return scratch.table(gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop")), "drop", keep=True)


def drop_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
               id_col: str = "doc_id", text: str = "text", block_lines: int = BLOCK_LINES, short: Rule = ()) -> DataFrame:
    """``docs`` with the lines that go taken out of the text, and ``n_lines`` and ``n_dropped``."""
    need(docs, id_col, text)
    with Scratch(docs.sparkSession, "lines") as scratch:
        drop = lines_to_drop(docs, scratch, max_edits, min_chars, id_col, text, block_lines, short)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    t, i = F.col(names[text]), F.col(names[id_col])
    same = (F.coalesce(i.cast("bigint"), F.lit(LAST_ID)) == F.col("doc_id")) & (F.xxhash64(i, t) == F.col("row"))
    lines = F.split(t, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = let(lines, lambda ls: F.transform(stay, lambda k: F.get(ls, k)))
    new = F.when(F.col("drop").isNull(), t).otherwise(F.array_join(kept, "\n"))
    # hashed, not sorted: the texts are on one side, line numbers on the other
    joined = rows.join(drop.hint("shuffle_hash"), same, "left")
    counts = {"n_lines": F.coalesce(F.size(lines).cast("bigint") * F.when(t.isNull(), 0).otherwise(1), F.lit(0)),
              "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("bigint") * F.when(F.col("drop").isNull(), 0).otherwise(1)}
    return joined.select(*((new if c == text else F.col(n)).alias(c) for c, n in names.items()),
                         *(v.alias(free_name(docs, k)) for k, v in counts.items()))
