"""Set operations (ST1-ST5)."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """ST1: union by column name; columns missing on one side are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: Mapping[str, DataFrame], tag: str = "src") -> DataFrame:
    """ST2: union with a source tag column."""
    return union_by_name([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def split_back(df: DataFrame, tag: str, name: str) -> DataFrame:
    """ST2: the rows of one source (a filter on the tag)."""
    return df.where(F.col(tag) == name)


def compare_key_sets(a: DataFrame, b: DataFrame, only_a: str = "only_a", both: str = "both",
                     kind: str = "kind") -> DataFrame:
    """ST3: distinct keys of ``a`` not in ``b`` and keys in both, tagged."""
    return a.subtract(b).withColumn(kind, F.lit(only_a)).unionByName(
        a.intersect(b).withColumn(kind, F.lit(both)))


def key_fanout(df: DataFrame, key: Column, suffixes: Sequence[str], out: str = "id") -> DataFrame:
    """ST4: emit each key once per suffix (generator, no join)."""
    arr = F.array(*[F.lit(s) for s in suffixes])
    return df.select("*", F.explode(arr).alias("_sfx")) \
        .withColumn(out, F.concat(key, F.col("_sfx"))).drop("_sfx")
