"""What the queries write of the roles, and in what pieces."""

import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shopfloor.plans.catalog import plan
from shopfloor.sources import warehouse
from shopfloor.sources.warehouse import persist_roles, warehouse_roles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    n, day = F.col("id"), F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(CAST(id % 900 AS INT))")
    tables = {
        "region": [n.alias("r_regionkey"), F.lit("ASIA").alias("r_name")],
        "nation": [n.alias("n_nationkey"), F.lit("INDIA").alias("n_name"), F.lit(0).cast("long").alias("n_regionkey")],
        "customer": [n.alias("c_custkey"), F.concat(F.lit("c"), n).alias("c_name"), (n * 0).alias("c_nationkey"), F.lit("m").alias("c_mktsegment")],
        "supplier": [n.alias("s_suppkey"), F.concat(F.lit("s"), n).alias("s_name"), (n * 0).alias("s_nationkey"), (n + 0.5).alias("s_acctbal")],
        "part": [n.alias("p_partkey"), F.concat(F.lit("p"), n).alias("p_name"), F.lit(1.5).alias("p_retailprice"), F.lit("b").alias("p_brand")],
        "orders": [n.alias("o_orderkey"), (n % 50).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), day.alias("o_orderdate")],
        "lineitem": [(n % 20_000).alias("l_orderkey"), (n % 9).alias("l_partkey"), (n % 7).alias("l_suppkey"), F.when(n % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
                     F.lit("N").alias("l_returnflag"), F.lit(2.0).alias("l_quantity"), (n + 0.25).alias("l_extendedprice"), F.lit(0.1).alias("l_tax"), F.lit(0.1).alias("l_discount"), day.alias("l_shipdate")]}
    rows = {"region": 1, "nation": 1, "customer": 50, "supplier": 7, "part": 9, "orders": 20_000, "lineitem": 60_000}
    for name, columns in tables.items():
        spark.range(rows[name]).select(*columns).write.parquet(f"{out}/{name}.parquet")
    return out


def stored(spark, pattern):
    return glob.glob(f"{warehouse.ensure_checkpoint_dir(spark).removeprefix('file:')}/shopfloor_roles/{pattern}")


def test_a_query_writes_only_the_roles_that_it_asks_for(spark, folder):
    before = set(stored(spark, "*"))
    for name, roles in (("v10_top_total_spender", {"service", "customer"}), ("q47_purchase_total_by_location", {"service", "customer", "purchase", "vendor"})):
        got = __spark_entry__.queries()[name](spark, folder).collect()
        (tag,) = set(stored(spark, "*")) - before
        assert {x.rsplit("/", 1)[1] for x in glob.glob(f"{tag}/*")} == roles
        assert got == plan(name, warehouse_roles(spark, folder), warehouse=True).collect() and got


def test_tasks_of_a_write_are_bounded_by_bytes(spark, folder, monkeypatch):
    """q06, q56: with more bytes than a task should hold there are more tasks, not larger ones."""
    monkeypatch.setattr(warehouse, "WRITE_BYTES", 32 << 10, raising=False)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    # As with orders too large to broadcast and tasks of more than the least size, here a megabyte.
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before, size = {k: spark.conf.get(k) for k in wanted}, spark.conf.get(advisory)
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        raw = warehouse_roles(spark, folder)
        roles = persist_roles(spark, raw, "bounded-writes")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.conf.get(advisory) == size
    assert len(stored(spark, "bounded-writes/service/part-*")) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for role in ("service", "purchase", "customer"):
        a, b = getattr(raw, role), getattr(roles, role)
        assert a.columns == b.columns and a.count() == b.count() and a.exceptAll(b).isEmpty()
