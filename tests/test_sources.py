"""Sources: CSV editions, Parquet round trip, warehouse role mapping invariants."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import project
from shopfloor.plans.catalog import plan
from shopfloor.session import ensure_checkpoint_dir
from shopfloor.sources.role_store import read_roles, write_roles
from shopfloor.sources.warehouse import warehouse_roles
from shopfloor.sources.workshop_csv import read_workshop_csv, rejected_lines

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


def test_editions_read_real_nulls_and_types(roles_a, roles_b):
    for roles in (roles_a, roles_b):
        emp = {r.eid: r for r in roles.employee.collect()}
        assert emp[3000].esal is None and emp[3001].edol is None and emp[3004].edol is not None
        assert dict(roles.employee.dtypes)["esal"] == "int"
        assert dict(roles.service.dtypes)["ser_date"] == "date"
    assert {r.eid: r.esal for r in roles_b.employee.collect()}[3002] == 110
    assert roles_b.employee.where(F.col("edol").isNotNull()).count() == 2


def test_parquet_round_trip(spark, roles_a):
    folder = ensure_checkpoint_dir(spark).rstrip("/") + "/test_role_store"
    write_roles(roles_a, folder)
    back = read_roles(spark, folder)
    for name in ("q15_annual_income", "q27_service_supply_report", "q48_purchase_total_in_words"):
        a, b = plan(name, roles_a), plan(name, back)
        assert project(a, a.columns) == project(b, a.columns)


def test_warehouse_roles_cover_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    r = warehouse_roles(spark, sf)
    line = spark.read.parquet(os.path.join(sf, "lineitem.parquet"))
    orders = spark.read.parquet(os.path.join(sf, "orders.parquet"))
    st = line.join(orders, line.l_orderkey == orders.o_orderkey)
    assert r.service.count() + r.purchase.count() == st.count()  # every line is in exactly one fact
    assert r.service.count() == st.where("l_linestatus = 'F'").count()
    # no signed zeros survive into the facts
    assert r.service.where(F.col("comm").cast("string") == "-0.0").count() == 0
    assert r.purchase.where(F.col("spgst").cast("string") == "-0.0").count() == 0
    assert r.customer.count() == spark.read.parquet(os.path.join(sf, "customer.parquet")).count()


def _edition(tmp_path, **changes):
    import shutil

    folder = tmp_path / "edition"
    shutil.copytree(os.path.join(FIXTURES, "edition_b"), folder)
    for name, lines in changes.items():
        with open(folder / f"{name}.csv", "a") as f:
            f.write("".join("\r\n" + line for line in lines))
    return str(folder)


def test_reading_csv_leaves_the_session_alone(spark, tmp_path):
    key = "spark.sql.csv.filterPushdown.enabled"
    for value in ("true", "false"):
        spark.conf.set(key, value)
        read_workshop_csv(spark, _edition(tmp_path / value)).service.where("1 = 1 OR sid > 3").count()
        assert spark.conf.get(key) == value
    spark.conf.unset(key)


def test_malformed_lines_are_named(spark, tmp_path):
    bad = {"customer": ["1009,X", "abc,TOM,PUNE,1,2,01-JAN-11,MALE"], "purchase": ["5011,2001,4001,1,1,1,99-XYZ-11,0,1,3001"]}
    folder = _edition(tmp_path, **bad)
    with pytest.raises(Exception, match="malformed line in customer.csv .*1009,X|malformed line in customer.csv .*abc,TOM"):
        read_workshop_csv(spark, folder).customer.collect()
    with pytest.raises(Exception, match="pdate is no date.*5011"):
        read_workshop_csv(spark, folder).purchase.collect()
    found = {(r["role"], r["file"], r["line"]) for r in rejected_lines(spark, folder).collect()}
    assert found == {(role, f"{role}.csv", line) for role, lines in bad.items() for line in lines}
    kept = read_workshop_csv(spark, folder, malformed="drop")
    assert (kept.customer.count(), kept.purchase.count()) == (8, 10)
    assert rejected_lines(spark, os.path.join(FIXTURES, "edition_b")).count() == 0
