"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularlab.session import scratch_path, track

# ASCII white space: the characters that separate words (bytes.split() uses the same set).
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"


class Scratch:
    """Tables written under the folder that ``spark.checkpoint.dir`` names.

    ``table(df)`` writes the rows once and reads them back, which cuts the
    lineage in a place every executor can read.  On leaving the context all of
    them are deleted except those asked for with ``keep=True`` (the result), which go with
    ``tabularlab.session.release_scratch``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def path(self, name: str) -> str:
        return scratch_path(self.spark, f"{self.name}-{name}-{uuid.uuid4().hex[:12]}")

    def table(self, df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
        path = self.path(name)
        df.write.mode("error").parquet(path)
        if keep:
            track(path)
        else:
            self.paths.append(path)
        # what was written no longer needs its shuffle files; Spark deletes them once the
        # driver's objects for them are collected, which may otherwise take very long
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            for file in t.inputFiles()[:1]:
                for p in [p for p in self.paths if f"/{p.rsplit('/', 1)[1]}/" in file]:
                    self._delete(p)
                    self.paths.remove(p)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        for p in self.paths:
            self._delete(p)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly before work that is heavy per row, whatever the file layout."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def crc32_of(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row (or element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores where the input already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

