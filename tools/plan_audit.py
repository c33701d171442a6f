"""Print plan facts for every registered question: exchanges to a single partition (and what
feeds them), cartesian products, nested-loop joins, Python evaluation, and the columns each
Parquet scan reads.

Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from shopfloor.plans.catalog import ALL, plan  # noqa: E402
from shopfloor.session import local_session  # noqa: E402
from shopfloor.sources.warehouse import warehouse_roles  # noqa: E402

HAZARDS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
           "FlatMapGroupsInPandas", "MapInPandas"]
SCAN = re.compile(r"FileScan parquet \[([^\]]*)\].*?/(\w+)(?:\.parquet)?\]")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    roles = warehouse_roles(spark, sf_dir)
    for name in ALL:
        text = plan(name, roles, warehouse=True)._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        single = [re.sub(r"^[\s:+\-*()0-9]*", "", lines[i + 1]).split("(")[0]
                  for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
        hazards = [h for h in HAZARDS if h in text]
        widths: dict[str, int] = {}
        for line in lines:
            m = SCAN.search(line)
            if m:
                widths[m.group(2)] = max(widths.get(m.group(2), 0), len(m.group(1).split(",")))
        print(f"{name}: single-partition inputs={sorted(set(single)) or '-'} hazards={hazards or '-'} "
              f"scan columns={widths}")


if __name__ == "__main__":
    main()
