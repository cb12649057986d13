"""Array expressions (SC9, TX7, TX8): higher-order functions, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(arr: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(arr, F.array_max(arr)).cast("int")


def weighted_dot(arr: Column, weights: Sequence[float]) -> Column:
    """Dot product with a literal weight vector."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(arr, w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def pad_left(arr: Column, length: int, fill=0) -> Column:
    """TX7: keep the last ``length`` items; left-pad with ``fill`` to ``length``."""
    n = F.size(arr)
    tail = F.when(n > length, F.slice(arr, n - length + 1, length)).otherwise(arr)
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(tail), F.lit(0)))
    return F.concat(pad, tail)


def sliding_windows(arr: Column, length: int) -> Column:
    """TX8: all windows of ``length`` consecutive items (array of arrays)."""
    n = F.size(arr)
    starts = F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(0)))
    return F.when(n >= length, F.transform(starts, lambda i: F.slice(arr, i, length))) \
        .otherwise(F.array().cast("array<array<int>>"))
