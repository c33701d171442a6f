"""Skew-safe operators against their naive single-task / quadratic forms, on warehouse data."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import project
from shopfloor.operators.cooccurrence import group_partners
from shopfloor.operators.keep_first import first_per_key
from shopfloor.operators.positions import row_at, select_nth, with_position, with_running_total
from shopfloor.operators.ranking import grade_by_dense_rank, rank_by_value

SF = "/root/testdata/sf0.001"
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_with_position_matches_row_number(lineitem, partitions):
    ours = with_position(lineitem, LINE_ORDER, partitions=partitions)
    naive = lineitem.withColumn("pos", F.row_number().over(Window.orderBy(*LINE_ORDER)).cast("bigint"))
    cols = LINE_ORDER + ["pos"]
    assert project(ours, cols) == project(naive, cols)


def test_row_at_even_count_is_lower_middle(spark, roles_a):
    extra = roles_a.service.where(F.col("sid") == 6007).withColumn("sid", F.lit(6008))
    service = roles_a.service.unionByName(extra)  # 8 rows
    n = service.agg(F.count("*")).scalar()
    got = row_at(service, ["sid"], F.ceil(n / 2)).select("sid").collect()
    assert [r.sid for r in got] == [6004]


@pytest.mark.parametrize("method,fn", [("rank", F.rank), ("dense_rank", F.dense_rank)])
def test_rank_by_value_matches_window(lineitem, method, fn):
    counts = lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    ours = rank_by_value(counts, "n", out="r", method=method)
    naive = counts.withColumn("r", fn().over(Window.orderBy(F.col("n").desc())).cast("bigint"))
    assert project(ours, ["l_suppkey", "n", "r"]) == project(naive, ["l_suppkey", "n", "r"])


@pytest.mark.parametrize("bands", [[(2, "A"), (4, "B")], [(1, "A"), (3, "B")], [(1, "A")], [(50, "A")]])
def test_grade_by_dense_rank_matches_window(spark, bands):
    # ties at every cut-off and NULLs
    vals = [5, 5, 4, 4, 4, 3, None, 2, 2, 1, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    ours = grade_by_dense_rank(df, "v", bands, "Z", out="g")
    dr = F.dense_rank().over(Window.orderBy(F.col("v").desc_nulls_last()))
    expr = None
    for k, label in bands:
        expr = F.when(dr <= k, label) if expr is None else expr.when(dr <= k, label)
    naive = df.withColumn("g", expr.otherwise("Z"))
    assert project(ours, ["id", "g"]) == project(naive, ["id", "g"])


def test_grade_when_only_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v int")
    assert project(grade_by_dense_rank(df, "v", [(1, "A")], "B", out="g"), ["id", "g"]) == [(1.0, "A"), (2.0, "A")]


def test_group_partners_matches_self_join(lineitem):
    ours = group_partners(lineitem, "l_suppkey", "l_partkey")
    m = lineitem.select("l_suppkey", "l_partkey").distinct()
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & (F.col("a.l_partkey") != F.col("b.l_partkey")),
                   "left")
    naive = pairs.groupBy(F.col("a.l_suppkey").alias("l_suppkey"), F.col("a.l_partkey").alias("l_partkey")) \
        .agg(F.count(F.col("b.l_partkey")).alias("n_partners"))
    cols = ["l_suppkey", "l_partkey", "n_partners"]
    assert project(ours, cols) == project(naive, cols)


def test_first_per_key_matches_row_number(lineitem):
    ours = first_per_key(lineitem, ["l_suppkey"], ["l_shipdate", "l_orderkey"])
    w = Window.partitionBy("l_suppkey").orderBy(*[F.col(c).asc_nulls_first() for c in
                                                  ["l_shipdate", "l_orderkey"] + [c for c in lineitem.columns
                                                                                  if c not in ("l_suppkey",
                                                                                               "l_shipdate",
                                                                                               "l_orderkey")]])
    naive = lineitem.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert project(ours, lineitem.columns) == project(naive, lineitem.columns)


@pytest.mark.parametrize("k", [1, 2, 777, 3001, 6000, 10 ** 9])
def test_select_nth_matches_row_number(lineitem, k):
    n = lineitem.count()
    got = select_nth(lineitem, LINE_ORDER, k)
    naive = lineitem.withColumn("rn", F.row_number().over(Window.orderBy(*LINE_ORDER))).where(F.col("rn") == k) \
        .drop("rn")
    assert project(got, LINE_ORDER) == project(naive, LINE_ORDER)
    assert got.count() == (1 if k <= n else 0)


def test_with_running_total_matches_window(lineitem):
    counts = lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    ours = with_running_total(counts, ["l_partkey"], "n", out="upto", partitions=4)
    naive = counts.withColumn("upto", F.sum("n").over(Window.orderBy("l_partkey")
                                                      .rowsBetween(Window.unboundedPreceding, 0)))
    assert project(ours, ["l_partkey", "upto"]) == project(naive, ["l_partkey", "upto"])
