import hashlib
import itertools
import random
import re
import zlib

import pytest

from tabularlab.llm import conversation as conv

SCHEMA = "conv_id long, turn long, role string, text string"
SMALL = "/root/testdata/sf0.001/conversations.parquet"


def brute_edits(symbols):
    """Least (cost, audit) over all edits, row by row."""
    best = {(0, 0): (0, "")}

    def offer(node, cost, audit):
        if node not in best or (cost, audit) < best[node]:
            best[node] = cost, audit

    for i in range(len(symbols) + 1):
        for _ in range(3):
            for q in (0, 1, 2, 3):
                if (i, q) in best:
                    cost, audit = best[i, q]
                    offer((i, 3 if q == 2 else 2), cost + 2, audit + "I")
        if i == len(symbols):
            break
        for q in (0, 1, 2, 3):
            if (i, q) not in best:
                continue
            cost, audit = best[i, q]
            offer((i + 1, q), cost + 3, audit + "D")
            if symbols[i] == 8:
                continue
            initial, late = divmod(symbols[i], 2)
            if q == 0 and initial == 0:
                offer((i + 1, 1), cost + late, audit + "K")
            want, to = (2, 3) if q == 2 else (1, 2)
            offer((i + 1, to), cost + late + 2 * (initial != want), audit + ("K" if initial == want else "R"))
    return min(best[len(symbols), q] for q in (0, 3) if (len(symbols), q) in best)


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 4:
            role = "user"
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_report(rows):
    damaged = brute_damage(rows)
    found = []
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == c), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            initial = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            symbols.append(8 if fault in (0, 1) else 2 * initial + (fault == 2))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = brute_edits(symbols)
        said, rest, last = [], iter(mine), ""
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            said.append(f"{role}:{row[3] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", "".join(s[0] for s in said))
        found.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def awkward():
    rng = random.Random(3)
    texts = [None, "", " \n", "Yes.", "Yes", "No?\n", "ok!", "naïve ﬁx 中文。", "w " * 30_000 + "."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice([None, "", "user", "assistant", "system", "tool", "Unknown"]), rng.choice(texts[:-1]))
            for c in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    rows += [rows[0], rows[0], rows[5], (None, None, None, None), (77, 3, "user", texts[-1]), (77, None, "system", "Be brief.")]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 90}.") for t in range(3000)]      # one long conversation
    return rows + [(501, 4, "user", "Again.")] * 50


def test_every_short_sequence_equals_brute_force():
    for n in range(5):
        for symbols in itertools.product(range(conv.SYMBOLS), repeat=n):
            assert conv.cheapest_edits(bytes(symbols)) == brute_edits(symbols)


def test_long_sequences_equal_brute_force():
    rng = random.Random(2)
    for _ in range(2000):
        symbols = bytes(rng.choices(range(conv.SYMBOLS), [4, 2, 9, 3, 9, 3, 2, 1, 3], k=rng.randint(5, 60)))
        assert conv.cheapest_edits(symbols) == brute_edits(symbols)


def test_tables_are_small_and_closed():
    t = conv.tables()
    assert len(t.vectors) < 1000 and t.block[0].shape == (len(t.vectors), conv.SYMBOLS ** conv.BLOCK)
    assert t.block[0].max() < len(t.vectors) and max(map(max, t.vectors)) <= conv.CUT


def test_awkward_rows_equal_brute_force(spark):
    rows = awkward()
    assert got(conv.damaged_report(spark.createDataFrame(rows, SCHEMA))) == brute_report(rows)


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet(SMALL)
    assert got(conv.damaged_report(df)) == brute_report([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Well?"), (2, 0, "assistant", "Yes."), (3, 0, "tool", "cut off")]
    turns = conv.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in turns] == [
        (1, "K", "user", "Hi."), (1, "R", "assistant", "Well?"), (2, "I", "user", ""), (2, "K", "assistant", "Yes.")]


def test_empty_table_and_clashing_names(spark):
    from pyspark.sql import functions as F
    empty = spark.createDataFrame([], SCHEMA)
    assert conv.damaged_report(empty).count() == 0 and conv.repaired_turns(empty).count() == 0
    rows = awkward()[:60]
    crowded = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in (
        "conv", "digest", "n", "fault", "first", "copies", "audit", "kind", "cost")))
    assert got(conv.damaged_report(crowded)) == brute_report(rows)


@pytest.mark.parametrize("field", ["conv", "text"])
def test_other_column_names(spark, field):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed({"conv": "conv_id", "text": "text"}[field], "other name")
    kwargs = {field: "other name"}
    assert conv.repair_plan(df, **kwargs).first().audit == "KK"
