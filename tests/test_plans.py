"""Physical-plan guards: no cartesian products, nested-loop joins or Python in any plan;
projections and filters reach the Parquet scans."""

import re

import pytest

from shopfloor.plans.catalog import ALL, plan
from shopfloor.sources.warehouse import warehouse_roles

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


@pytest.fixture(scope="module")
def roles(spark):
    return warehouse_roles(spark, SF)


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_children(text):
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("name", sorted(ALL))
def test_single_partition_exchanges_only_above_aggregates(roles, name):
    """Data reaches one task only as aggregated rows: global aggregates after per-task partial
    aggregation, per-partition size tables, or the bounded distinct-count table of a rank."""
    text = _plan_text(plan(name, roles, warehouse=True))
    assert not [f for f in FORBIDDEN if f in text]
    assert all("HashAggregate" in child for child in _single_partition_children(text))


def test_column_pruning_reaches_the_scan(roles):
    text = _plan_text(plan("q23_count_by_vehicle_type", roles, warehouse=True))
    scans = re.findall(r"lineitem\.parquet.*?ReadSchema: struct<([^>]*)>", text)
    assert scans, text
    for schema in scans:
        assert set(re.findall(r"(\w+):", schema)) == {"l_orderkey", "l_returnflag", "l_linestatus"}


def test_status_filters_are_pushed_down(roles):
    text = _plan_text(plan("q47_purchase_total_by_location", roles, warehouse=True))
    assert re.search(r"lineitem\.parquet.*?PushedFilters: \[[^\]]*EqualTo\(l_linestatus,O\)", text)
