"""String expressions (SC1-SC6), all built from JVM-side functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(col: Column, sep: str, n: int) -> Column:
    """SC1: n-th part (1-based) of ``col`` split on the literal ``sep``; '' when absent."""
    return F.split_part(col, F.lit(sep), F.lit(n))


def extract_groups(col: Column, pattern: str, names: Sequence[str]) -> list[Column]:
    """SC2 / D8: regex capture groups as columns; no match -> null (not '')."""
    return [F.nullif(F.regexp_extract(col, pattern, i + 1), F.lit("")).alias(name)
            for i, name in enumerate(names)]


def first_match(col: Column, classes: Sequence[tuple[str, str]], default: str = "-") -> Column:
    """SC3: label of the first pattern matching at the start of the text."""
    expr = None
    for label, rx in classes:
        cond = col.rlike(f"^(?:{rx})")
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def count_literal(col: Column, needle: str) -> Column:
    """SC5: non-overlapping occurrences of a literal substring."""
    import re
    return F.regexp_count(col, F.lit(re.escape(needle)))


def is_digits(col: Column) -> Column:
    """SC4: str.isdigit for non-empty text."""
    return col.rlike("^[0-9]+$")
