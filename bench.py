"""Benchmark: run every registered question on the warehouse tables and time it.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed to completion with the ``noop`` sink (every row is
produced, nothing is collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shopfloor.plans.catalog import ALL, plan  # noqa: E402
from shopfloor.session import local_session  # noqa: E402
from shopfloor.sources.warehouse import persist_roles, warehouse_roles  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    default_parts = max(8, 2 * int(cpus)) if cpus.isdigit() else 16
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", default_parts))
    spark = local_session(cpus, shuffle_partitions=parts, app="shopfloor-bench")
    spark.sparkContext.setLogLevel("ERROR")
    raw = warehouse_roles(spark, sf_dir)
    # Warm-up: JVM class loading and the Parquet footers, not counted.
    plan("q23_count_by_vehicle_type", raw, warehouse=True).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    # Deriving the role tables (lineitem ⋈ orders, dimensions ⋈ nation) once for the suite is counted.
    t0 = time.perf_counter()
    roles = persist_roles(spark, raw, "bench-" + re.sub(r"[^A-Za-z0-9]+", "_", sf_dir).strip("_"))
    timings["materialize_roles"] = round(time.perf_counter() - t0, 3)
    for name in ALL:
        if only and not any(o in name for o in only):
            continue
        t0 = time.perf_counter()
        plan(name, roles, warehouse=True).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(timings.values()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(sf.group(1)) if sf else sf_dir, "n_queries": len(timings)}))


if __name__ == "__main__":
    main()
