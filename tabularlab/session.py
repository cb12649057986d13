"""Session helpers.

On a cluster the session comes from the platform; ``get_session`` is for
tests, the bench and local runs.  Only settings that are unset are filled in,
so a cluster's own values (shuffle partitions, checkpoint folder) win.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from measured sizes (this
# is the size check behind every broadcast that is not of a fixed-size
# dimension), coalesces small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabularlab") -> SparkSession:
    master = master or os.environ.get("TABULARLAB_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TABULARLAB_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only when it is unset (tests, a laptop) do we create
    one of our own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tabularlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # no SparkContext on this client (e.g. Spark Connect): written tables still work
        pass
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared checkpoint folder for written stage tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str = "stage"):
    """Cut lineage with a written table: the rows are written once as parquet
    into a fresh folder under the shared checkpoint folder and read back.

    Used for intermediates read by several branches of a plan (so the large
    input behind them is scanned once) and for values that must not be
    recomputed differently (row numbers).  Unlike ``Dataset.checkpoint`` this
    computes the plan once, stores columns compressed, and gives the optimizer
    real sizes; a lost executor re-reads files instead of recomputing."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def one_row_batches(spark: SparkSession):
    """Rows go to Python one by one in what runs while this holds: for rows that are whole blocks of work."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_written: list[str] = []     # tables that materialize() has written in this process


def track(path: str) -> None:
    """Have ``release_scratch`` delete this folder, too."""
    _written.append(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written so far.  Call it when no
    DataFrame that reads them is used any more; it also runs when the process ends."""
    sc = spark.sparkContext
    while _written:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            release_scratch(spark)
        except Exception:  # the JVM may be gone already: nothing left to ask
            pass


def spread(df, *keys):
    """Deal rows over all tasks before work that is heavy per row (tokenising whole texts,
    parsing HTML), by the given keys or evenly.

    How many rows a scan task holds depends on row groups, which byte splits do not
    show, so this always exchanges; ``spark.sql.shuffle.partitions`` sets the width."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
