"""Property tests: random inputs (ties, NULLs, negatives) against plain-Python or naive-window answers.

Each example is one small Spark job, so the example counts are kept low.
"""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import project
from shopfloor.functions.words import amount_in_words, spell_integer
from shopfloor.operators.positions import select_nth, with_position
from shopfloor.operators.ranking import grade_by_dense_rank, rank_by_value

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

small_values = st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40)


@SETTINGS
@given(st.lists(st.integers(-(10 ** 18), 10 ** 18), min_size=1, max_size=200))
def test_words_match_python(spark, nums):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(nums)], "i int, n long")
    got = df.select("i", amount_in_words(F.col("n")).alias("a"), amount_in_words("n").alias("b")).collect()
    for r in got:
        assert r.a == r.b == spell_integer(nums[r.i])


@SETTINGS
@given(small_values, st.lists(st.integers(1, 6), min_size=1, max_size=3, unique=True), st.booleans())
def test_grades_match_dense_rank(spark, vals, limits, descending):
    bands = [(k, f"G{k}") for k in sorted(limits)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    ours = grade_by_dense_rank(df, "v", bands, "Z", out="g", descending=descending)
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    dr = F.dense_rank().over(Window.orderBy(order))
    expr = None
    for k, label in bands:
        expr = F.when(dr <= k, label) if expr is None else expr.when(dr <= k, label)
    naive = df.withColumn("g", expr.otherwise("Z"))
    assert project(ours, ["id", "g"]) == project(naive, ["id", "g"])


@SETTINGS
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40))
def test_ranks_match_window(spark, vals):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v long")
    for method, fn in (("rank", F.rank), ("dense_rank", F.dense_rank)):
        ours = rank_by_value(df, "v", out="r", method=method)
        naive = df.withColumn("r", fn().over(Window.orderBy(F.col("v").desc())).cast("bigint"))
        assert project(ours, ["id", "r"]) == project(naive, ["id", "r"])


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 3)), min_size=1, max_size=40),
       st.integers(1, 45), st.integers(1, 4))
def test_positions_and_nth_match_row_number(spark, rows, k, parts):
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "a int, b int, i int")
    order = ["a", "b", "i"]  # i makes the order total
    naive = df.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    assert project(with_position(df, order, partitions=parts), ["i", "pos"]) == project(naive, ["i", "pos"])
    assert project(select_nth(df, order, k), ["i"]) == project(naive.where(F.col("pos") == k), ["i"])
