"""Job timings of one question, from Spark's event log (no web UI).

Usage: python tools/job_times.py QUESTION [sf_dir]
Writes the event log to a fresh scratch folder (mktemp), runs the question once
after a warm-up, and prints each job's start offset, duration and stage count.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def _read_log(folder: str) -> list[dict]:
    events = []
    for path in sorted(glob.glob(os.path.join(folder, "*", "events_*")) + glob.glob(os.path.join(folder, "app*"))):
        raw = open(path, "rb").read()
        if path.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode(errors="replace").splitlines():
            try:
                events.append(json.loads(line))
            except ValueError:
                continue
    return events


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from pyspark.sql import SparkSession

    from shopfloor.plans.catalog import ALL, plan
    from shopfloor.sources.warehouse import suite_roles

    name = name if name in ALL else next(k for k in ALL if k.startswith(name))
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", scratch)
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    roles = suite_roles(spark, sf_dir)
    roles.validate()  # asks for every role, so that none is written in the measured part
    plan("q23_count_by_vehicle_type", roles, warehouse=True).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("measured", name)
    t0 = time.perf_counter()
    plan(name, roles, warehouse=True).write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    spark.stop()
    jobs: dict[int, list] = {}
    for e in _read_log(scratch):
        if e["Event"] == "SparkListenerJobStart" and e.get("Properties", {}).get("spark.jobGroup.id") == "measured":
            jobs[e["Job ID"]] = [e["Submission Time"], e["Submission Time"], len(e["Stage Infos"])]
        elif e["Event"] == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    first = min((v[0] for v in jobs.values()), default=0)
    for job, (start, end, stages) in sorted(jobs.items()):
        print(f"job {job:4d}  +{start - first:6d} ms  {end - start:6d} ms  {stages} stage(s)")
    print(f"{name}: {len(jobs)} jobs, {sum(v[1] - v[0] for v in jobs.values())} ms in jobs, "
          f"{wall * 1000:.0f} ms wall; event log in {scratch}")


if __name__ == "__main__":
    main()
