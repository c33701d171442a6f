"""The driver contract in __spark_entry__.py, and the command line."""

import os

import __spark_entry__ as E
from shopfloor.plans.catalog import ALL


def test_every_question_has_an_oracle():
    assert set(ALL) <= set(E.queries()) and set(ALL) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries()) and len(ALL) >= 90


def test_entry_runs_on_smallest_tables(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["vadd", "total_amount", "amount_in_words"]
    assert len(rows) > 0 and all(r.amount_in_words for r in rows)


def test_query_callables_take_spark_and_folder(spark):
    df = E.queries()["q23_count_by_vehicle_type"](spark, "/root/testdata/sf0.001")
    assert sorted(r.type_veh for r in df.collect()) == ["A", "N", "R"]


def test_cli_lists_and_runs(capsys, spark):
    from shopfloor.__main__ import main

    assert main(["--list"]) == 0
    assert "q47_purchase_total_by_location" in capsys.readouterr().out
    assert main(["--csv", os.path.join(os.path.dirname(__file__), "fixtures", "edition_a"), "q47"]) == 0
    assert "PUNE" in capsys.readouterr().out
    assert main(["--warehouse", "/root/testdata/sf0.001", "--explain", "q23"]) == 0
    assert "Physical Plan" in capsys.readouterr().out


def test_suite_roles_once_under_concurrency(spark):
    from concurrent.futures import ThreadPoolExecutor

    from shopfloor.sources.warehouse import suite_roles

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: suite_roles(spark, "/root/testdata/sf0.001"), range(4)))
    assert all(r is got[0] for r in got)
    assert got[0].service.count() > 0
