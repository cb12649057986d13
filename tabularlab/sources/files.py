"""File sources and sinks (SRC1-SRC16).

Paths for intermediate tables live under the shared folder named by
``spark.checkpoint.dir``, one fresh sub-folder per run.  Off a local master that
setting is required.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabularlab.session import scratch_path


def run_folder(spark: SparkSession, name: str) -> str:
    """A new, unique folder for this run inside the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True,
             sep: str = ",", encoding: str = "UTF-8", null_value: str | None = None,
             date_format: str | None = None, timestamp_format: str | None = None) -> DataFrame:
    """SRC1-SRC4: CSV scan.  With a declared ``schema`` no inference pass runs
    (inference reads the data twice and is off for production scans)."""
    r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding).option("mode", "FAILFAST")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if date_format:
        r = r.option("dateFormat", date_format)
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", encoding: str = "UTF-8",
              null_value: str | None = None, date_format: str | None = None, mode: str = "overwrite") -> str:
    """SRC16: CSV export (one file per partition, header in each)."""
    w = df.write.mode(mode).option("header", header).option("sep", sep).option("encoding", encoding)
    if null_value is not None:
        w = w.option("nullValue", null_value)
    if date_format:
        w = w.option("dateFormat", date_format)
    w.csv(path)
    return path


def sample_rows(df: DataFrame, fraction: float | None = None, seed: int = 0, limit: int | None = None,
                key: str | None = None, buckets: int = 1000, keep: int | None = None) -> DataFrame:
    """SRC6: bounded / sampled read.  ``key`` + ``keep`` gives a reproducible
    hash sample (rows whose hash bucket of ``key`` is < keep of ``buckets``), the same on
    every run and partitioning; ``fraction`` uses Bernoulli sampling; ``limit``
    caps the row count (a feature of this operator, not a shortcut)."""
    from tabularlab.functions.hashing import unit_hash_of
    out = df
    if key is not None and keep is not None:
        out = out.where(F.floor(unit_hash_of(df, key, 0) * buckets) < keep)
    if fraction is not None:
        out = out.sample(withReplacement=False, fraction=fraction, seed=seed)
    if limit is not None:
        out = out.limit(limit)
    return out


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str], mode: str = "overwrite",
                      max_records_per_file: int | None = None) -> str:
    """SRC7: partitioned parquet sink.  Rows are rebalanced by the partition
    columns: each task writes few files, and Spark splits the tasks of a hot
    value by size, so a value with a third of the rows has as many writers as its
    bytes ask for."""
    out = df.hint("rebalance", *partition_cols) if partition_cols else df
    w = out.write.mode(mode).partitionBy(*partition_cols)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return path


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, table: str | None = None) -> str:
    """SRC7: a table bucketed and sorted by ``keys``; returns its name.  Two tables bucketed alike are joined,
    and one is grouped by the keys, without an exchange.  Rows are dealt by the same hash first, so there is
    one file per bucket.  The number of buckets sets a join task's size: choose it by bytes."""
    name = table or f"bucketed_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path) \
        .format("parquet").saveAsTable(name)
    return name


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], row_group_bytes: int = 8 << 20, bloom: Sequence[str] = (),
                 distinct: int | None = None) -> str:
    """SRC7, PRJ19: a table in the order of ``keys`` over all its files, with row groups of the given size and
    Bloom filters on ``bloom`` columns (for about ``distinct`` values a row group).  Row-group statistics
    then let a point or range read on the keys, and the filters one on other columns, pass over most row groups."""
    w = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", row_group_bytes) \
        .option("parquet.block.size.row.check.min", 100).option("parquet.block.size.row.check.max", 1000)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if distinct:
            w = w.option(f"parquet.bloom.filter.expected.ndv#{c}", distinct)
    w.parquet(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def partition_values(spark: SparkSession, root: str, col: str) -> list[str]:
    """Values of a partition column from the directory listing (no data read)."""
    fs, p = _fs(spark, root.rstrip("/") + f"/{col}=*")
    st = fs.globStatus(p) or []
    return sorted(s.getPath().getName().split("=", 1)[1] for s in st)


class PartitionFilterError(ValueError):
    pass


def scan_partitions(spark: SparkSession, root: str, col: str, regex: str, columns: Sequence[str] | None = None,
                    check: bool = True) -> DataFrame:
    """SRC8: read a partitioned parquet root keeping the partitions whose value
    matches ``regex`` (partition pruning - the other directories are never
    opened) and only ``columns`` (column pruning).  Raises when the filter keeps
    no partition or all of them, a sign of a wrong pattern."""
    if check:
        import re
        vals = partition_values(spark, root, col)
        kept = [v for v in vals if re.search(regex, v)]
        if not kept or len(kept) == len(vals):
            raise PartitionFilterError(f"partition filter {regex!r} keeps {len(kept)} of {len(vals)} partitions")
    df = spark.read.parquet(root).where(F.col(col).cast("string").rlike(regex))
    return df.select(*columns) if columns else df


def stage_checkpoint(df: DataFrame, name: str) -> DataFrame:
    """SRC9: write an intermediate to parquet in the shared folder and read it
    back: lineage is cut and a lost executor recomputes from the files."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_once(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """SRC10: return the table at ``path``; build and write it only when it is
    missing or ``force`` is set."""
    if force or not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_class_lists(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """SRC11: JSON objects {class: [path, ...]} -> (class_label, split_label, path).

    The split label is the name of the folder holding the file (a ``key=``
    prefix is dropped).  ``whole_file`` parses each file as one (possibly
    multi-line) object; otherwise every line is an object, so a large listing
    is spread over many tasks."""
    # text() has its own wholetext argument, which would override an option()
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=whole_file) \
        .select("value", F.col("_metadata.file_path").alias("_file"))
    m = F.from_json("value", "map<string,array<string>>")
    split = F.regexp_extract("_file", r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    return raw.select(split.alias("split_label"), F.explode(m).alias("class_label", "_paths")) \
        .select("class_label", "split_label", F.explode("_paths").alias("path"))


def read_text_corpus(spark: SparkSession, path: str, doc_marker: str | None = None) -> DataFrame:
    """SRC12: one row per file (whole text) with its file name; with ``doc_marker``
    one row per document.  The marker is the reader's record separator, so a large
    file is split over many tasks and never held as one row."""
    reader = spark.read.option("recursiveFileLookup", True)
    raw = reader.text(path, wholetext=True) if doc_marker is None else reader.text(path, lineSep=doc_marker)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows if doc_marker is None else rows.where(F.length("text") > 0)


def read_labelled_folders(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC13: every file under ``path``; class label = parent directory name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("class_label"))


def read_word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None,
                      token_col: str = "token") -> DataFrame:
    """SRC14: text file with a "count dim" header line then "token f1 ... fd"
    lines -> (token, vector array<float>); optionally only tokens of a vocabulary
    (semi join, so the vocabulary is never collected)."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.split(F.trim("value"), " ").alias("f"))
    body = lines.where(F.size("f") > 2)
    vec = body.select(F.col("f")[0].alias("token"),
                      F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("float")).alias("vector"))
    if vocabulary is not None:
        vec = vec.join(vocabulary.select(F.col(token_col).alias("token")), "token", "left_semi")
    return vec
