"""Streaming jobs resume from their checkpoint: no duplicates, new files only."""

import os

import pytest
from pyspark.sql import functions as F

from tabularlab.sources.files import run_folder
from tabularlab.streaming.incremental import incremental_copy, windowed_counts


def test_incremental_scan_resumes_without_duplicates(spark):
    base = run_folder(spark, "t-stream")
    first = spark.range(0, 1000).withColumn("v", F.col("id") * 2)
    first.repartition(4).write.parquet(base + "/in/batch=1")
    schema = "id long, v long, batch int"
    out = incremental_copy(spark, base + "/in", spark.createDataFrame([], schema).schema,
                           base + "/out", base + "/ckpt", max_files_per_trigger=1)
    assert out.count() == 1000
    # a restart with nothing new adds nothing
    out = incremental_copy(spark, base + "/in", spark.createDataFrame([], schema).schema,
                           base + "/out", base + "/ckpt", max_files_per_trigger=1)
    assert out.count() == 1000
    # appended files are picked up exactly once
    spark.range(1000, 1500).withColumn("v", F.col("id") * 2).repartition(2).write.parquet(base + "/in/batch=2")
    out = incremental_copy(spark, base + "/in", spark.createDataFrame([], schema).schema,
                           base + "/out", base + "/ckpt", max_files_per_trigger=1)
    assert out.count() == 1500 and out.select("id").distinct().count() == 1500


def _events(spark, rows):
    return spark.createDataFrame(rows, "id long, ts string").select("id", F.to_timestamp_ntz("ts").alias("ts"))


def _counts(spark, base, ev, n):
    out = windowed_counts(spark, base + "/in", ev.schema, "ts", "id", base + "/out", base + "/ckpt", max_files_per_trigger=n)
    return {r["window_start"].strftime("%Y-%m-%d"): r["n"] for r in out.collect()}


def test_windowed_counts_match_batch(spark):
    base = run_folder(spark, "t-window")
    ev = _events(spark, [(i, f"2024-01-0{1 + i % 3} 0{i % 10}:00:00") for i in range(90)])
    ev.repartition(3).write.parquet(base + "/in")
    _events(spark, [(None, "2024-01-07 00:00:00")]).write.mode("append").parquet(base + "/in")
    assert _counts(spark, base, ev, None) == {"2024-01-01": 30, "2024-01-02": 30, "2024-01-03": 30}


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    base = run_folder(spark, "t-late")
    ev = _events(spark, [(1, "2024-01-01 08:00:00"), (2, "2024-01-05 08:00:00")])
    ev.coalesce(1).write.parquet(base + "/in")
    # the watermark is now 01-04 08:00: the first day is closed, the fifth is open
    assert _counts(spark, base, ev, 1) == {"2024-01-01": 1}
    late = _events(spark, [(3, "2024-01-01 09:00:00"), (4, "2024-01-05 09:00:00")])
    late.coalesce(1).write.mode("append").parquet(base + "/in")
    assert _counts(spark, base, ev, 1) == {"2024-01-01": 1}
    _events(spark, [(None, "2024-01-09 00:00:00")]).write.mode("append").parquet(base + "/in")
    assert _counts(spark, base, ev, 1) == {"2024-01-01": 1, "2024-01-05": 2}


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_upserts_survive_a_restart_between_batches(spark, mode):
    from tabularlab.streaming import incremental as IN
    base = run_folder(spark, f"t-upsert-{mode}")
    first = _events(spark, [(i, f"2024-01-0{1 + i % 3} 0{i % 10}:00:00") for i in range(30)])

    def run():
        out = IN.upserted_counts(spark, base + "/in", first.schema, "ts", "id", base + "/out", base + "/ckpt", mode, max_files_per_trigger=1)
        return {r.window_start.strftime("%m-%d"): r.n for r in out.collect()}

    first.coalesce(1).write.parquet(base + "/in")
    assert run() == {"01-01": 10, "01-02": 10, "01-03": 10}          # open windows are there, no end marker needed
    more = _events(spark, [(100, "2024-01-03 20:00:00"), (101, "2024-01-05 01:00:00"), (102, "2024-01-03 21:00:00")])
    more.coalesce(1).write.mode("append").parquet(base + "/in")
    assert run() == {"01-01": 10, "01-02": 10, "01-03": 12, "01-05": 1}
    # the watermark is 01-04 01:00 now: a row for the first day is late
    _events(spark, [(200, "2024-01-01 12:00:00"), (201, "2024-01-05 02:00:00")]).coalesce(1).write.mode("append").parquet(base + "/in")
    assert run() == {"01-01": 10 + (mode == "complete"), "01-02": 10, "01-03": 12, "01-05": 2}


def test_a_batch_that_runs_twice_counts_once(spark):
    """The commit of the last batch is lost, as when the driver dies behind the write: the batch runs again."""
    from tabularlab.streaming import incremental as IN
    base = run_folder(spark, "t-twice")
    ev = _events(spark, [(i, f"2024-01-0{1 + i % 2} 0{i % 10}:00:00") for i in range(20)])
    ev.coalesce(1).write.parquet(base + "/in")
    run = lambda: {r.window_start.strftime("%m-%d"): r.n for r in IN.upserted_counts(
        spark, base + "/in", ev.schema, "ts", "id", base + "/out", base + "/ckpt", max_files_per_trigger=1).collect()}
    once = run()
    commits = sorted((p for p in os.listdir(base + "/ckpt/commits") if p.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{base}/ckpt/commits/{name}"):
            os.unlink(f"{base}/ckpt/commits/{name}")
    assert run() == once == {"01-01": 10, "01-02": 10}
