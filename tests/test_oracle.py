"""Every registered query against its DuckDB oracle SQL on the smallest warehouse tables
(the driver's correctness gate, in small)."""

import duckdb
import pytest

import __spark_entry__ as E
from shopfloor.plans.catalog import ALL
from helpers import norm

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(norm(dict(zip(cols, r))[c]) for c in df.columns) for r in res.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in df.columns) for r in df.collect()), key=repr)
    assert got == want
