"""Structured Streaming re-aims (SS1, SS2).

Both use ``trigger(availableNow=True)``: every file present at start is
processed in bounded micro-batches, then the query stops.  State and progress
live in a checkpoint location under the shared checkpoint folder, so a restart
(or a lost executor) resumes from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ntz_as_utc_instant(c):
    """Wall-clock timestamp_ntz -> the instant of that wall-clock time in UTC
    (second precision), independent of the session time zone."""
    secs = (F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    return F.timestamp_seconds(secs)


def utc_instant_as_ntz(c):
    """Inverse of ``ntz_as_utc_instant`` for whole seconds."""
    secs = F.unix_seconds(c)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(secs / 86400).cast("int"))
    rem = F.pmod(secs, F.lit(86400))
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.floor(rem / 3600).cast("int"),
                                F.floor(F.pmod(rem, F.lit(3600)) / 60).cast("int"), F.pmod(rem, F.lit(60)).cast("int"))


def incremental_copy(spark: SparkSession, src: str, schema: StructType, sink: str, checkpoint: str,
                     max_files_per_trigger: int | None = 2, timeout_s: int = 600) -> DataFrame:
    """SS1: scan an append-only parquet directory in micro-batches of at most
    ``max_files_per_trigger`` files, append to a parquet sink; returns the sink."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(src)
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("incremental scan did not drain")
    if q.exception():
        raise q.exception()
    return spark.read.schema(schema).parquet(sink)


def windowed_counts(spark: SparkSession, src: str, schema: StructType, ts: str, counted: str, sink: str, checkpoint: str,
                    window: str = "1 day", watermark: str = "1 day", max_files_per_trigger: int | None = 2,
                    timeout_s: int = 600) -> DataFrame:
    """SS2: tumbling-window counts of non-null ``counted`` with a late-data bound.

    Append mode: a window is written once, when the watermark (the latest event time
    seen so far, less the delay) has passed its end; its state is then dropped, and
    rows that come later for it are dropped, too.  Windows that the watermark has
    not passed stay open: a later event (or an end marker with a null ``counted``) closes them."""
    stream = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    # watermarks need TIMESTAMP (an instant); a wall-clock NTZ column is turned
    # into the instant of that wall-clock time in UTC, whatever the session time
    # zone, so day windows are calendar days of the data
    events = stream.parquet(src).withColumn(ts, ntz_as_utc_instant(F.col(ts)))
    counts = (events.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"))
              .agg(F.count(counted).alias("n")).where(F.col("n") > 0)
              .select(utc_instant_as_ntz(F.col("w.start")).alias("window_start"),
                      utc_instant_as_ntz(F.col("w.end")).alias("window_end"), "n"))
    q = (counts.writeStream.format("parquet").option("path", sink).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("windowed count did not drain")
    if q.exception():
        raise q.exception()
    return spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, n long").parquet(sink)


WINDOWS = "window_start timestamp_ntz, window_end timestamp_ntz, n long"


def latest_counts(spark: SparkSession, sink: str, mode: str) -> DataFrame:
    """The windows as of the last finished batch.  Update mode: each window's count in the latest batch that
    changed it; complete mode: the rows of the latest batch."""
    rows = spark.read.schema(WINDOWS + ", batch long").parquet(sink)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))          # one row
        return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")
    return rows.groupBy("window_start", "window_end").agg(F.max_by("n", "batch").alias("n"))


def upserted_counts(spark: SparkSession, src: str, schema: StructType, ts: str, counted: str, sink: str, checkpoint: str,
                    mode: str = "update", window: str = "1 day", watermark: str = "1 day", max_files_per_trigger: int | None = 2,
                    timeout_s: int = 600) -> DataFrame:
    """SS2: tumbling-window counts that are there as soon as a batch ends, without an end marker.

    Each micro-batch writes the windows it changed (``update``) or all windows (``complete``) to
    a folder of the sink that its batch id names, in place of what that folder held.  A batch that is run
    again after a failure or a restart has the same id and rows and so leaves the same folder: the
    sink never counts a row twice.  Update mode drops the state of windows the watermark has passed, and rows
    that come later for them; complete mode keeps every window and counts late rows."""
    if mode not in ("update", "complete"):
        raise ValueError("mode must be update or complete")
    stream = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    events = stream.parquet(src).withColumn(ts, ntz_as_utc_instant(F.col(ts)))
    counts = events.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w")).agg(F.count(counted).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("n") > 0).select(
            utc_instant_as_ntz(F.col("w.start")).alias("window_start"), utc_instant_as_ntz(F.col("w.end")).alias("window_end"), "n")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = (counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("windowed count did not drain")
    if q.exception():
        raise q.exception()
    return latest_counts(spark, sink, mode)
