"""Job and stage times from a Spark event log (no UI needed).

Run a job with spark.eventLog.enabled=true and spark.eventLog.dir set to a
scratch folder, then:  python tools/event_times.py <eventlog dir or file>
Prints one line per job: start offset, duration, and its slowest stages with
their task counts (a long stage with 1 task points at lost parallelism).
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        if f.endswith(".zstd"):
            import zstandard
            stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8")
        else:
            stream = open(f, encoding="utf-8")
        yield from stream


def main() -> None:
    jobs, stages = {}, {}
    for line in lines(sys.argv[1]):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "stages": e["Stage IDs"]}
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si.get("Completion Time", 0) - si.get("Submission Time", 0), si["Number of Tasks"])
    if not jobs:
        return
    t0 = min(j["start"] for j in jobs.values())
    for k, j in sorted(jobs.items()):
        st = sorted((stages[s] for s in j["stages"] if s in stages), reverse=True)[:3]
        print(f"job {k}: +{(j['start'] - t0) / 1000:.2f}s  {(j.get('end', j['start']) - j['start']) / 1000:.2f}s  "
              f"stages(ms, tasks) {st}")


if __name__ == "__main__":
    main()
