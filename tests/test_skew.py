"""Hot keys: one key holding about a third of all rows.

The skewed inputs are derived from the given warehouse tables (every line with
return flag 'R' — about a third — is moved onto one supplier / part / order).
AQE's skew thresholds are lowered so that its skew-join splitting actually
runs at this size; results must still equal the naive forms.
"""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import norm, project
from shopfloor.operators.cooccurrence import group_partners
from shopfloor.operators.keep_first import first_per_key
from shopfloor.operators.positions import select_nth, with_position
from shopfloor.operators.ranking import rank_by_value
from shopfloor.plans.catalog import plan
from shopfloor.plans.oracle_sql import oracle_queries
from shopfloor.sources.warehouse import read_warehouse, roles_from_tables

SF = "/root/testdata/sf0.001"


def hot():
    return F.col("l_returnflag") == "R"


@pytest.fixture(scope="module")
def skew_conf(spark):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_tables(spark, skew_conf):
    t = read_warehouse(spark, SF)
    line = t["lineitem"]
    t["lineitem"] = (line.withColumn("l_suppkey", F.when(hot(), F.lit(0).cast("bigint")).otherwise(F.col("l_suppkey")))
                     .withColumn("l_partkey", F.when(hot(), F.lit(0).cast("bigint")).otherwise(F.col("l_partkey"))))
    return t


def test_hot_employee_pairs(hot_tables):
    svc = roles_from_tables(hot_tables).service
    ours = group_partners(svc, "eid", "cid")
    m = svc.select("eid", "cid").distinct()
    naive = m.groupBy("eid").agg(F.count("*").alias("k")).join(m, "eid") \
        .select("eid", "cid", (F.col("k") - 1).alias("n_partners"))
    assert project(ours, ["eid", "cid", "n_partners"]) == project(naive, ["eid", "cid", "n_partners"])
    assert ours.where("eid = 0").count() > ours.where("eid <> 0").groupBy("eid").count().agg(F.max("count")).first()[0]


def test_hot_first_per_key_and_rank(hot_tables):
    line = hot_tables["lineitem"]
    ours = first_per_key(line, ["l_suppkey"], ["l_orderkey", "l_linenumber"])
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", *[
        F.col(c).asc_nulls_first() for c in line.columns if c not in ("l_suppkey", "l_orderkey", "l_linenumber")])
    naive = line.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert project(ours, line.columns) == project(naive, line.columns)
    counts = line.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    ranked = rank_by_value(counts, "n", out="r")
    naive_r = counts.withColumn("r", F.rank().over(Window.orderBy(F.col("n").desc())).cast("bigint"))
    assert project(ranked, ["l_suppkey", "r"]) == project(naive_r, ["l_suppkey", "r"])


def test_hot_order_key_positions(hot_tables):
    # a third of all lines share one order key: the remaining order columns split it
    line = hot_tables["lineitem"].withColumn("l_orderkey", F.when(hot(), F.lit(7).cast("bigint"))
                                             .otherwise(F.col("l_orderkey")))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ours = with_position(line, order, partitions=6)
    naive = line.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    assert project(ours, order + ["pos"]) == project(naive, order + ["pos"])


@pytest.mark.parametrize("name", ["q27_service_supply_report", "q60_part_age_at_use", "q59_vendors_with_unused_parts",
                                  "q33_rank_employees_by_services", "q09_first_service_per_customer",
                                  "q39_services_shared_city", "q22_items_by_location"])
def test_hot_questions_match_sql(spark, hot_tables, name):
    roles = roles_from_tables(hot_tables)
    got = plan(name, roles, warehouse=True)
    con = duckdb.connect()
    for tname, df in hot_tables.items():
        con.register(tname, df.toPandas())
    res = con.execute(oracle_queries()[name])
    cols = [d[0] for d in res.description]
    exp = [dict(zip(cols, r)) for r in res.fetchall()]
    want = sorted((tuple(norm(r[c]) for c in got.columns) for r in exp), key=repr)
    assert project(got, got.columns) == want


def test_hot_key_select_nth(hot_tables):
    line = hot_tables["lineitem"].withColumn("l_orderkey", F.when(hot(), F.lit(7).cast("bigint"))
                                             .otherwise(F.col("l_orderkey")))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    naive = line.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    for k in (1, 50, 1500, line.count()):
        want = naive.where(F.col("rn") == k).drop("rn")
        assert project(select_nth(line, order, k), order) == project(want, order)
