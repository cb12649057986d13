"""Cheapest repair of the turn structure of conversations, by Four-Russians block tables.

A repaired conversation's role initials are nothing, or an optional system turn
and then (user, assistant) pairs.  Edits per row: Keep 0, Rerole to user or
assistant 2, Delete 3 (the only choice for blank and duplicate rows); Insert an
empty user or assistant turn anywhere 2; a truncated row that stays adds 1.

What a row costs depends on one of nine symbols only (its initial, whether it
is truncated, or that it must go).  The cost vector over the four states of the
target pattern, less its least entry and cut at ``CUT``, takes few values, so the step over
every block of ``BLOCK`` symbols from every such vector is computed once (``tables``).
A conversation goes forward by one lookup per block.  Blocks are then expanded from the
last to the first: inside each, the states that lie on some cheapest path are
marked, and with them the ASCII-least edits from each such state.  As the edits
settle the states, a forward walk along marked states gives the least audit of
all cheapest ones.  Expansions are kept in a bounded table.

``CUT`` loses nothing: any state can follow another's best path for at most 7
more (one deleted system row, two inserted turns), so a state that costs 8 or
more above the cheapest lies on no cheapest path.

Work is dealt in two passes.  The plan works on narrow rows (no texts): equal rows are
counted, earlier equal turns found by aggregation, and each conversation's symbols
walked in order; a task holds one conversation's symbols, a byte a row, as its audit.
The second pass streams the texts in order past the audit and holds one row at a time.

Defined cases: a null role or text is one space; a null conv_id is a conversation
of its own; null turns come first.  Rows of one turn are ordered by role, then by
the text's MD5, and equal rows stand together.  An empty table gives an empty one; a
conversation without rows (``n`` 0) has zeros, an empty audit and the hash of nothing.
Columns other than the four named are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularlab.llm.common import need

BLOCK = 4                      # symbols of a table entry
CUT = 8                        # see above
GONE = 8                       # symbol of a row that must be deleted
SYMBOLS = 9                    # 2 * initial (s, u, a, other) + truncated, or GONE
EXPANSIONS = 1 << 16           # bound of the table of expanded blocks
START, SYSTEM, USER, ASSISTANT = range(4)      # what stands last: nothing, s, u, a
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1


def closed(v: tuple) -> tuple:
    """The cost vector with inserted turns allowed."""
    user = min(v[USER], v[START] + INSERT, v[SYSTEM] + INSERT, v[ASSISTANT] + INSERT)
    return v[START], v[SYSTEM], user, min(v[ASSISTANT], user + INSERT)


def moves(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in this state."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, extra = divmod(symbol, 2)
        turn, after = (2, ASSISTANT) if state == USER else (1, USER)
        if initial == turn:
            found.append(("K", extra * CUT_OFF, after))
        else:
            found.append(("R", REROLE + extra * CUT_OFF, after))
        if state == START and initial == 0:
            found.append(("K", extra * CUT_OFF, SYSTEM))
    return found


def inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def step(v: tuple, symbol: int) -> tuple:
    out = [CUT * 4] * 4
    for state, cost in enumerate(v):
        for _, price, after in moves(state, symbol):
            out[after] = min(out[after], cost + price)
    return closed(tuple(out))


def normal(v: tuple) -> tuple[tuple, int]:
    low = min(v)
    return tuple(min(x - low, CUT) for x in v), low


class Tables:
    """``one`` and ``block``: next vector and added cost by (vector, symbol) and (vector, block)."""

    def __init__(self):
        first, _ = normal(closed((0, CUT, CUT, CUT)))
        self.vectors, number, steps = [first], {first: 0}, []
        for v in self.vectors:                     # grows while new vectors are found
            row = []
            for symbol in range(SYMBOLS):
                to, cost = normal(step(v, symbol))
                if to not in number:
                    number[to] = len(self.vectors)
                    self.vectors.append(to)
                row.append((number[to], cost))
            steps.append(row)
        one = np.array(steps, np.int32)
        self.one = to, cost = one[..., 0], one[..., 1]
        for _ in range(BLOCK - 1):
            cost = (cost[:, :, None] + self.one[1][to]).reshape(len(to), -1)
            to = self.one[0][to].reshape(len(to), -1)
        self.block = to, cost


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def marked_inserts(v: tuple, live: int) -> int:
    """``live`` with the states added from which an inserted turn leads on to a marked one."""
    for state in (ASSISTANT, USER, ASSISTANT, SYSTEM, START):
        to = inserted(state)
        if live >> to & 1 and v[state] + INSERT == v[to]:
            live |= 1 << state
    return live


@lru_cache(EXPANSIONS)
def expand(vector: int, symbols: bytes, live: int) -> tuple[int, tuple]:
    """For the block's cost vector before it and the marked states behind it: the marked
    states before it and, for each, its least edits and the state behind the block."""
    columns = [tables().vectors[vector]]
    for s in symbols:
        columns.append(step(columns[-1], s))
    marks = [live]
    for i in range(len(symbols) - 1, -1, -1):
        v, after = columns[i], columns[i + 1]
        now = sum(1 << q for q in range(4) if any(
            marks[0] >> to & 1 and v[q] + cost == after[to] for _, cost, to in moves(q, symbols[i])))
        marks.insert(0, marked_inserts(v, now))
    walks = []
    for q in range(4):
        if not marks[0] >> q & 1:
            walks.append(None)
            continue
        edits, i = "", 0
        while i < len(symbols):
            v, after = columns[i], columns[i + 1]
            ways = [(e, to) for e, cost, to in moves(q, symbols[i])
                    if marks[i + 1] >> to & 1 and v[q] + cost == after[to]]
            to = inserted(q)
            if marks[i] >> to & 1 and v[q] + INSERT == v[to]:
                ways.append(("I", to))
            edit, q = min(ways)
            edits += edit
            i += edit != "I"
        walks.append((edits, q))
    return marks[0], tuple(walks)


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of that cost."""
    t = tables()
    at, total, whole = 0, 0, len(symbols) // BLOCK * BLOCK
    before = []
    codes = np.frombuffer(symbols[:whole], np.uint8).reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    for code in codes.tolist():
        before.append(at)
        total += int(t.block[1][at, code])
        at = int(t.block[0][at, code])
    if whole < len(symbols):
        before.append(at)
        for s in symbols[whole:]:
            total += int(t.one[1][at, s])
            at = int(t.one[0][at, s])
    last = t.vectors[at]
    least = min(last[START], last[ASSISTANT])
    live = marked_inserts(last, sum(1 << q for q in (START, ASSISTANT) if last[q] == least))
    found = []
    for b in range(len(before) - 1, -1, -1):
        live, walks = expand(before[b], symbols[b * BLOCK:(b + 1) * BLOCK], live)
        found.append(walks)
    state, edits = START, []
    for walks in reversed(found):
        part, state = walks[state]
        edits.append(part)
    while not (state in (START, ASSISTANT) and last[state] == least):
        edits.append("I")
        state = inserted(state)
    return total + least, "".join(edits)


def symbol_of(initial: str, fault: int) -> int:
    return GONE if fault == 2 else 2 * ("sua".find(initial) if initial and initial in "sua" else 3) + fault


def with_copies(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv, turn, role, text, digest, n): the rows in the form that both passes read."""
    need(rows, conv, turn, role, text)
    name = {c: F.col(f"`{c}`") for c in (conv, turn, role, text)}
    said = F.coalesce(name[text].cast("string"), F.lit(" "))
    n = F.col(f"`{copies}`") if copies else F.lit(1)
    return rows.select(name[conv].alias("conv"), name[turn].cast("bigint").alias("turn"),
                       F.coalesce(name[role].cast("string"), F.lit(" ")).alias("role"), said.alias("text"),
                       F.md5(said.cast("binary")).alias("digest"), n.cast("bigint").alias("n"))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one partition and in order."""
    return rows.repartition("conv").sortWithinPartitions(
        F.asc_nulls_first("conv"), *first, F.asc_nulls_first("turn"), "role", "digest")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, fault, n, first): equal rows counted; fault 0 none, 1 truncated,
    2 blank; ``first`` where the first of the n rows has no equal one at an earlier turn."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(end == "", 2).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    counted = rows.select("conv", "turn", "role", "digest", fault.alias("fault"), "n") \
        .groupBy("conv", "turn", "role", "digest", "fault").agg(F.sum("n").alias("n"))
    at = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))      # null turns are the earliest
    earliest = counted.where("n > 0").groupBy("conv", "role", "digest").agg(F.min(at).alias("at")) \
        .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return counted.join(earliest, same, "left") \
        .select("conv", "turn", "role", "digest", "fault", "n", (F.col("at") == at).alias("first"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Walk:
    """One conversation's rows, in order."""

    def __init__(self):
        self.symbols, self.previous = bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, fault: int, n: int, first: bool) -> None:
        if not n:
            return
        initial = role[:1]
        if self.previous is not None:
            self.illegal += self.previous + initial not in LEGAL
        self.illegal += n - 1                      # equal neighbours never fit
        self.previous = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if fault == 2:
            self.blank += n
            self.symbols.extend(bytes([GONE]) * n)
            return
        self.duplicate += n - first
        if first:
            self.truncated += fault
            self.symbols.append(symbol_of(initial, fault))
        self.symbols.extend(bytes([GONE]) * (n - first))

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest_edits(bytes(self.symbols))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, room: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows that close once their strings pass ``room``."""
    held, used = [], 0
    for r in rows:
        held.append(r)
        used += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(held) == size or used > room:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def plan_of(rows: DataFrame) -> DataFrame:
    slim = in_order(faults(rows)).select("conv", "turn", "role", "fault", "n", "first")
    schema = T.StructType([slim.schema["conv"], *(T.StructField(c, T.LongType(), False) for c in COUNTS),
                           T.StructField("audit", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plans(stream):
            walk, current = None, None
            for conv, *row in stream:
                if walk is None or conv != current:
                    if walk is not None:
                        yield current, *walk.result()
                    walk, current = Walk(), conv
                walk.add(*row)
            if walk is not None:
                yield current, *walk.result()

        head = next(batches, None)
        if head is None:
            return
        fields = [pa.field("conv", head.schema.field(0).type), *(pa.field(c, pa.int64()) for c in COUNTS),
                  pa.field("audit", pa.string())]

        def all_rows():
            yield from rows_in([head])
            yield from rows_in(batches)

        yield from in_batches(plans(all_rows()), pa.schema(fields))

    return slim.mapInArrow(run, schema)


ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired turns (edit, role, text) of one conversation's (role, text, n) rows in order."""
    state, edits = START, iter(audit)

    def insert():
        nonlocal state
        state = inserted(state)
        return "I", ROLE_OF[state], b""

    for role, text, n in rows:
        for _ in range(n):
            while (edit := next(edits)) == "I":
                yield insert()
            if edit == "K":
                state = START + 1 + "sua".index(role[0])
                yield "K", role, text
            elif edit == "R":
                state = inserted(state)
                yield "R", ROLE_OF[state], text
    for _ in edits:                                # what is left can only be inserts
        yield insert()


def streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's audit (first) and its rows in order: (conv, kind, audit, role, text, n, counts...)."""
    audits = plan.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("digest"), F.col("audit").cast("binary").alias("text"), F.lit(0).cast("bigint").alias("n"),
                         F.struct(*COUNTS).alias("counts"))
    said = rows.where("n > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "digest",
                                      F.col("text").cast("binary").alias("text"), "n",
                                      F.lit(None).cast(audits.schema["counts"].dataType).alias("counts"))
    return in_order(audits.unionByName(said), "kind").select("conv", "kind", "role", "text", "n", "counts")


def conversations_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, audit, counts, rows) per conversation; ``rows`` is read before the next one."""
    stream = rows_in(batches)
    row = next(stream, None)
    while row is not None:
        conv, _, _, audit, _, counts = row
        ahead = None

        def rest():
            nonlocal ahead
            for r in stream:
                if r[1] == 0:
                    ahead = r
                    return
                yield r[2], r[3], r[4]

        rows = rest()
        yield conv, audit.decode(), counts, rows
        for _ in rows:
            pass
        row = ahead


def repair_plan(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                copies: str | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit.
    ``copies`` names a column that says how often a row stands there (0: not at all)."""
    return plan_of(with_copies(rows, conv, turn, role, text, copies)).withColumnRenamed("conv", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   copies: str | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, position from 0, edit, role, text)."""
    form = with_copies(rows, conv, turn, role, text, copies)
    source = streamed(form, plan_of(form))
    schema = T.StructType([T.StructField(conv, source.schema["conv"].dataType), T.StructField("position", T.LongType()),
                           T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])
    return source.mapInArrow(lambda batches: _stream(batches, _turns, [
        ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]), schema)


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  copies: str | None = None) -> DataFrame:
    """The plan's columns and repaired_sha256, the hash of the repaired ``role:text``, newline-joined."""
    form = with_copies(rows, conv, turn, role, text, copies)
    source = streamed(form, plan_of(form))
    schema = T.StructType([T.StructField(conv, source.schema["conv"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return source.mapInArrow(lambda batches: _stream(batches, _digests, [
        *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]), schema)


def _stream(batches: Iterator[pa.RecordBatch], made, fields: list) -> Iterator[pa.RecordBatch]:
    head = next(batches, None)
    if head is None:
        return

    def all_batches():
        yield head
        yield from batches

    schema = pa.schema([pa.field("conv", head.schema.field(0).type), *(pa.field(*f) for f in fields)])
    yield from in_batches(made(all_batches()), schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, audit, _, rows in conversations_in(batches):
        for i, (edit, role, text) in enumerate(edited(audit, rows)):
            yield conv, i, edit, role, text.decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, audit, counts, rows in conversations_in(batches):
        digest = hashlib.sha256()
        for i, (_, role, text) in enumerate(edited(audit, rows)):
            digest.update((b"\n" if i else b"") + role.encode() + b":")
            digest.update(text)
        yield conv, *(counts[c] for c in COUNTS), audit, digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """The fixed damage of ``op12_conversation_repair``: rows with ``copies`` 0, 1 or 2."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def damaged_report(rows: DataFrame) -> DataFrame:
    """The digest of ``op12_conversation_repair``."""
    return repair_report(damaged(rows), copies="copies")
