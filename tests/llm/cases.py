"""Awkward documents that every operator and stage has to take."""

import random

VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "so", "ti", "re", "mu") for b in ("lin", "dor", "ves", "pat") for c in ("a", "en", "ix", "ol")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = ("the quick brown fox jumps over the lazy dog while seven wizards mix strange potions in a quiet "
        "old tower near the river bank every autumn night")
OTHER = ("numbers and letters fill this rather different second paragraph whose only purpose is to share "
         "nothing much with its neighbour on the page above")


def rows():
    """Nulls in every column, empty, blank and long texts, exact and near copies, ties and repeated rows."""
    rng = random.Random(1)
    long_text = "\n".join(" ".join(rng.choices(VOCABULARY, k=rng.randint(5, 20))) for _ in range(3000))
    texts = [GOOD, OTHER, None, "", "   \n\t ", GOOD, GOOD.replace("seven", "eleven"), "one", long_text,
             GOOD + "\n" + OTHER, "ab " * 400, "naïve Ünïcode ﬁx 中文字 <|endoftext|>   end " + GOOD, "x" * 5000,
             "\n\n", GOOD.upper(), "<b> | * # " * 20 + GOOD]
    made = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3] if i < 12 else "a", None if t is None else len(t))
            for i, t in enumerate(texts)]
    return [*made, made[0], made[0], (None, OTHER, None, None, None), (None, None, None, None, None),
            (100, GOOD, "de", "b", len(GOOD)), (50, OTHER, "de", "b", len(OTHER))]


def near_equal_text(lines=3000):
    """Lines with a common ending that differ in two numbers: many distinct lines under one segment key."""
    return "\n".join(f"line {i} of a very long text says {i * 7919 % 1000} and {OTHER[:40]}" for i in range(lines))


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(spark):
    """Extra columns whose names clash with what operators add or use inside."""
    from pyspark.sql import functions as F
    df = documents(spark)
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(
        ["kept", "copy", "shard", "slot", "size", "fp", "row", "key", "drop", "n_lines", "c0", "_s", "_n", "h", "id", "crc"])))
