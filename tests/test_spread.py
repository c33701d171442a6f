"""No task gets a hot key whole, inputs are read once, and no plan sorts a fact to keep a first row."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import project
from shopfloor.operators.cooccurrence import group_partners
from shopfloor.operators.hot_keys import SALTS, checked_unique, salted_join
from shopfloor.operators.keep_first import first_per_key
from shopfloor.operators.many_to_many import summarise_matches
from shopfloor.operators.membership import fact_absent, fact_present
from shopfloor.operators.ranking import rank_by_value
from shopfloor.plans.catalog import plan
from shopfloor.plans.variants import v27_vehicle_supply_report
from shopfloor.sources.role_store import read_roles, write_roles
from shopfloor.sources.warehouse import read_warehouse, roles_from_tables, warehouse_roles

SF = "/root/testdata/sf0.001"
PARTITIONS = 32


@pytest.fixture(scope="module")
def plain(spark):
    """No broadcast joins, and no AQE, so that what is seen is the plan's own doing."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(PARTITIONS)}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_roles(spark, tmp_path_factory):
    """A third of all lines on one supplier and part, stored as Parquet."""
    t = read_warehouse(spark, SF)
    hot = F.col("l_returnflag") == "R"
    t["lineitem"] = t["lineitem"].withColumns({k: F.when(hot, F.lit(7).cast("bigint")).otherwise(F.col(k)) for k in ("l_suppkey", "l_partkey")})
    folder = str(tmp_path_factory.mktemp("hot") / "roles")
    write_roles(roles_from_tables(t), folder)
    return read_roles(spark, folder)


def largest_share(df, key, value=7):
    """The largest part of the hot key's rows that one task of the last stage holds."""
    per_task = df.withColumn("_task", F.spark_partition_id()).where(F.col(key) == value).groupBy("_task").count().collect()
    return max(r["count"] for r in per_task) / sum(r["count"] for r in per_task)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join_and_spreads_the_hot_key(plain, hot_roles, how):
    big = hot_roles.service.select("sid", "spid", "total")
    keys = hot_roles.part.select("spid", "spname").where("spid % 3 = 0" if how == "left_anti" else "spid % 2 = 1")
    ours = salted_join(big, keys, "spid", how)
    assert project(ours, ours.columns) == project(big.join(keys, "spid", how), ours.columns)
    assert largest_share(ours, "spid") < 2.5 / SALTS
    assert largest_share(big.join(keys, "spid", how), "spid") == 1.0  # what it is there for


def test_facts_and_keys_just_grouped(plain, hot_roles):
    keys = hot_roles.purchase.where("spid % 2 = 1").select("spid").distinct()
    for ours, how in ((fact_present(hot_roles.service, keys, "spid"), "left_semi"), (fact_absent(hot_roles.service, keys.where("spid <> 7"), "spid"), "left_anti")):
        other = keys if how == "left_semi" else keys.where("spid <> 7")
        assert project(ours, ours.columns) == project(hot_roles.service.join(other, "spid", how), ours.columns)
        assert largest_share(ours, "spid") < 2.5 / SALTS


def test_matches_and_partners_spread_the_hot_key(plain, hot_roles):
    ours = summarise_matches(hot_roles.service, hot_roles.purchase, "spid", [F.count("*").alias("n")], right_extra=hot_roles.part.select("spid", "spname"))
    assert largest_share(ours, "spid") < 2.5 / SALTS
    assert largest_share(group_partners(hot_roles.service, "eid", "cid"), "eid") < 2.5 / SALTS


def test_vehicle_listing_spreads_the_hot_part(plain, hot_roles):
    vehicle = hot_roles.service.where("spid = 7").first()["veh_no"]
    listing = v27_vehicle_supply_report(hot_roles, veh_no=vehicle)
    named = hot_roles.part.where("spid = 7").first()["spname"]
    assert listing.where(F.col("spname") == named).count() >= hot_roles.purchase.where("spid = 7").count()
    text = listing._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(spid" in text and "_salt" in text and text.count("roles/purchase]") == 1


@pytest.mark.parametrize("name", ["q27_service_supply_report", "q60_part_age_at_use", "q40_customer_pairs_same_employee", "q49_customer_spend_rating"])
def test_facts_are_read_once(spark, hot_roles, name):
    df = plan(name, hot_roles, warehouse=True)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for fact in ("service", "purchase"):
        assert text.count(f"roles/{fact}]") <= 1, name


def test_a_second_row_for_a_key_is_refused(spark):
    big, small = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int"), spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, y string")
    with pytest.raises(Exception, match="more than one row for k"):
        salted_join(big, small, "k").collect()
    with pytest.raises(Exception, match="more than one row for k"):
        summarise_matches(big, big, "k", [F.count("*").alias("n")], right_extra=small).collect()
    assert checked_unique(small.where("y <> 'b'"), "k").count() == 3
    assert salted_join(big, small.where("y <> 'b'"), "k", "left").orderBy("k").collect() == [(1, 2, "a"), (2, 3, None)]


@pytest.mark.parametrize("name", ["q09_first_service_per_customer", "v03_dedup_by_key", "v03_dedup_by_key_comm", "v04_top1_row", "v05_bottom1_positive", "v10_top_part_amount", "v24_top_service_gst"])
def test_no_sort_aggregate(spark, name):
    df = plan(name, warehouse_roles(spark, SF), warehouse=True)
    df.collect()
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_first_row_is_not_moved_whole(plain, hot_roles):
    """Rows of the hot key meet their leading value spread over it; only ties go on."""
    from shopfloor.operators import keep_first

    service = hot_roles.service
    ours = first_per_key(service, ["eid"], ["sid"])
    naive = service.withColumn("_r", F.row_number().over(Window.partitionBy("eid").orderBy("sid", *[F.col(c).asc_nulls_first() for c in service.columns if c not in ("eid", "sid")]))).where("_r = 1").drop("_r")
    assert project(ours, ours.columns) == project(naive, ours.columns)
    best = keep_first._leading(service, ["eid"], "sid").select(F.col("eid").alias("_eid"), F.col("sid").alias("_sid"))
    met = service.join(best, service["eid"].eqNullSafe(best["_eid"]) & service["sid"].eqNullSafe(best["_sid"]), "left_outer")
    assert largest_share(met, "eid") < 0.3


@pytest.mark.parametrize("order", [["a"], ["s"], ["d", "a"], ["s", "d"]])
def test_first_per_key_with_nulls_and_texts(spark, order):
    rows = [(k, a, s, d) for k in (None, 1, 2) for a in (None, 3, 1) for s in (None, "b", "a", "") for d in (None, 0.5, -0.0, float("nan"))]
    df = spark.createDataFrame(rows, "k int, a int, s string, d double").where("k IS NULL OR k = 1 OR (a = 3 AND s <> '' AND d = 0.5)")
    rest = [c for c in ("a", "s", "d") if c not in order]
    first = F.row_number().over(Window.partitionBy("k").orderBy(*[F.col(c).asc_nulls_first() for c in order + rest]))
    assert project(first_per_key(df, ["k"], order), df.columns) == project(df.withColumn("_r", first).where("_r = 1").drop("_r"), df.columns)
    assert first_per_key(df.limit(0), ["k"], order).collect() == []


def test_building_the_middle_record_plan_runs_nothing(spark):
    roles = warehouse_roles(spark, SF)
    spark.sparkContext.setJobGroup("middle", "plan only")
    df = plan("q06_middle_record", roles, warehouse=True)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("middle")) == []
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("method", ["rank", "dense_rank"])
def test_rank_of_any_values(spark, method, descending):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate([5, 5, 4, None, 2.5, 2.5, -1, None, 9, 9, 9])], "id int, v double")
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    naive = df.withColumn("r", getattr(F, method)().over(Window.orderBy(order)).cast("bigint"))
    ours = rank_by_value(df, "v", out="r", method=method, descending=descending)
    assert project(ours, ["id", "r"]) == project(naive, ["id", "r"])
    text = ours._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(text):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in text[i + 1]  # totals of the ranges only
