"""Edge inputs the original data lacks: NULL keys, empty tables, mixed case, namesakes, date text order."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import expect, project
from shopfloor.functions.dates import parse_day_month_year
from shopfloor.functions.words import amount_in_words, spell_integer
from shopfloor.plans.catalog import plan


def _with_service_row(spark, roles, **changes):
    base = roles.service.where(F.col("sid") == 6001)
    for col, value in changes.items():
        base = base.withColumn(col, F.lit(value).cast(roles.service.schema[col].dataType))
    return replace(roles, service=roles.service.unionByName(base))


def test_null_keys_do_not_empty_anti_joins(spark, roles_a):
    r = _with_service_row(spark, roles_a, sid=6100, cid=None, eid=None, spid=None)
    # NOT IN over a column holding NULL would return nothing; the anti join keeps its answer.
    assert project(plan("q02_unserviced_customers", r), ["cname"]) == expect(["SANJU SAMSUNG", "TOM HILL"])
    assert len(plan("q19_parts_never_purchased", replace(r, purchase=r.purchase.unionByName(
        r.purchase.limit(1).withColumn("spid", F.lit(None).cast("int"))))).collect()) == 7
    assert project(plan("q55_left_without_service", r), ["ename"]) == expect(["SHERI GOMES"])
    assert len(plan("q18_purchased_unused_parts", r).collect()) == 4
    assert len(plan("q59_vendors_with_unused_parts", r).collect()) == 4


def test_empty_service_table(spark, roles_a):
    r = replace(roles_a, service=roles_a.service.limit(0))
    assert plan("q04_max_commission_employee", r).count() == 0
    assert plan("q10_max_single_payment_customer", r).count() == 0
    assert plan("q20_profit_loss", r).collect()[0][0] is None
    assert plan("q06_middle_record", r).count() == 0
    assert plan("q42_employee_rating", r).where("rating = 'D'").count() == 6
    e = replace(roles_a, employee=roles_a.employee.limit(0))
    assert plan("q08_row_count_no_count", e).collect()[0][0] is None


def test_mixed_case_types(spark, roles_a):
    r = _with_service_row(spark, roles_a, sid=6101, cid=1005, type_veh="Two Wheeler", typ_ser="Color")
    assert project(plan("q12_two_wheeler_customers", r), ["two_wheeler_customers"]) == expect([6])
    assert project(plan("q14_colour_customers", r), ["cname"]) == expect(["CHRISTANA", "KAMILA JOSEF", "TOM HILL"])


def test_namesakes_are_grouped_by_id(spark, roles_a):
    twin = roles_a.customer.where(F.col("cid") == 1002).withColumn("cid", F.lit(1099))
    r = replace(roles_a, customer=roles_a.customer.unionByName(twin))
    r = _with_service_row(spark, r, sid=6102, cid=1099, total=100)
    # JOHN SMITH (1002) has two services; the namesake 1099 has one: still one repeat customer.
    assert project(plan("q21_repeat_customers", r), ["cname"]) == expect(["JOHN SMITH"])
    spend = project(plan("q50_spend_above_max_single", r), ["cname", "customer_total_spend"])
    assert spend == expect([("JOHN SMITH", 1504)])


def test_calendar_not_text_order_for_first_service(spark, roles_a):
    # '01-DEC-10' sorts after '01-APR-11' as text but is earlier on the calendar.
    r = _with_service_row(spark, roles_a, sid=6103, eid=3002)
    r = replace(r, service=r.service.withColumn(
        "ser_date", F.when(F.col("sid") == 6103, F.lit("2010-12-01").cast("date")).otherwise(F.col("ser_date"))))
    assert project(plan("q56_first_service_employee", r), ["ename"]) == expect(["DAVID AUSTIN"])


def test_null_and_zero_commissions(spark, roles_a):
    r = _with_service_row(spark, roles_a, sid=6104, comm=None)
    got = project(plan("q37_default_commission", r).where("sid = 6104"), ["new_commission"])
    assert got == expect([100])
    zero = replace(roles_a, service=roles_a.service.withColumn("comm", F.lit(0)))
    assert plan("q05_min_positive_commission", zero).count() == 0


def test_count_fill_does_not_touch_other_nulls(spark, roles_a):
    r = replace(roles_a, customer=roles_a.customer.withColumn(
        "creditdays", F.when(F.col("cid") == 1005, F.lit(None)).otherwise(F.col("creditdays"))))
    row = plan("q44_service_count_per_customer", r).where("cid = 1005").collect()[0]
    assert row.total_services == 0 and row.creditdays is None


def test_ties_at_grade_cutoffs(spark, roles_a):
    # Two more employees share the second-highest salary: still dense rank 2 → grade A.
    extra = roles_a.employee.where(F.col("eid") == 3004).withColumn("eid", F.lit(3010)).withColumn("ename", F.lit("X"))
    r = replace(roles_a, employee=roles_a.employee.unionByName(extra))
    got = dict(project(plan("q35_salary_grade_rank", r), ["ename", "salary_grade"]))
    assert got["X"] == "A" and got["LUIS POP"] == "A" and got["STEVEN KING"] == "B"


@pytest.mark.parametrize("chunk", range(3))
def test_amount_in_words_matches_python_spelling(spark, chunk):
    edge = [0, 7, 19, 20, 21, 99, 100, 101, 110, 999, 1000, 1001, 1010, 1099, 1100, 10000, 100000, 100001,
            1000000, 1000001, 1001000, 2000050, 999999999, -1, -1000, -999999, 10 ** 15 + 7, 9 * 10 ** 17 + 1]
    nums = edge + [(i * 7919 + chunk * 104729) ** 2 % (10 ** (3 + chunk * 4)) for i in range(300)]
    df = spark.createDataFrame([(n,) for n in nums], "n long")
    got = {r.n: (r.w, r.s) for r in df.select("n", amount_in_words(F.col("n")).alias("w"),
                                              amount_in_words("n").alias("s")).collect()}
    for n in nums:
        assert got[n] == (spell_integer(n), spell_integer(n)), n


def test_amount_in_words_null_and_fraction(spark):
    df = spark.createDataFrame([(None,), (12.99,), (-0.99,), (1000.5,)], "x double")
    for words in (amount_in_words(F.col("x")), amount_in_words("x")):
        got = [r.w for r in df.select(words.alias("w")).collect()]
        assert got == [None, "twelve", "zero", "one thousand"]


def test_amount_in_words_does_not_round(spark):
    df = spark.createDataFrame([(0.9999999,), (-1999.9999999,)], "x double")
    assert [r.w for r in df.select(amount_in_words("x").alias("w")).collect()] == \
        ["zero", "minus one thousand, nine hundred and ninety-nine"]


def test_amounts_below_a_cent_count(spark, roles_a):
    r = replace(roles_a, service=roles_a.service.withColumn("total", F.lit(0.0025)))
    assert set(project(plan("v43_total_per_customer", r), ["total_spent"])) == {(0.0025,), (0.005,)}


def test_malformed_date_fails(spark):
    df = spark.createDataFrame([("",), (None,), ("02-JAN-11",)], "t string")
    assert [r.d.isoformat() if r.d else None for r in df.select(parse_day_month_year(F.col("t")).alias("d")).collect()] == [None, None, "2011-01-02"]
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|could not be parsed"):
        spark.createDataFrame([("02/01/11",)], "t string").select(parse_day_month_year(F.col("t"))).collect()


def test_namesake_employees_counted_separately(spark, roles_a):
    twin = roles_a.employee.where(F.col("eid") == 3001).withColumn("eid", F.lit(3011))
    r = replace(roles_a, employee=roles_a.employee.unionByName(twin))
    r = _with_service_row(spark, r, sid=6105, eid=3011)
    got = project(plan("q34_service_count_by_job_filter", r), ["ename", "service_count"])
    assert got == expect([("DAVID AUSTIN", 2), ("STEVEN KING", 4), ("STEVEN KING", 1)])


def test_first_hired_by_calendar(spark, roles_a):
    # '01-DEC-07' sorts after '01-APR-08' as text, but is the earliest date.
    e = roles_a.employee.withColumn(
        "edoj", F.when(F.col("eid") == 3005, F.lit("2007-12-01").cast("date")).otherwise(F.col("edoj")))
    got = project(plan("v56_first_hired", replace(roles_a, employee=e)), ["ename"])
    assert got == expect(["SHERI GOMES"])


def test_null_commission_in_income(spark, roles_a):
    r = _with_service_row(spark, roles_a, sid=6106, eid=3002, comm=None)
    got = dict(project(plan("q15_annual_income", r), ["ename", "annual_income"]))
    assert got["DAVID AUSTIN"] == 13300.0 and got["JAMES PHILIP"] is None


def test_totals_above_a_quadrillion_keep_their_cents(spark, roles_a):
    from dataclasses import replace
    from decimal import Decimal

    rows = [(i, 1, 1, Decimal("900000000000000.07")) for i in range(3)] + [(9, 1, 1, Decimal("0.01"))]
    big = spark.createDataFrame(rows, "sid int, cid int, eid int, total decimal(20,2)")
    service = big.withColumns({c: F.lit(None).cast("double") for c in ("qty", "sp_rate", "sp_amt", "sp_g", "ser_amt", "comm")})
    service = service.withColumns({c: F.lit(None).cast("string") for c in ("type_veh", "veh_no", "typ_ser")}).withColumns({"ser_date": F.lit(None).cast("date"), "spid": F.lit(1)})
    customer = roles_a.customer.limit(1).withColumn("cid", F.lit(1))
    r = replace(roles_a, service=service, customer=customer)
    assert plan("v43_total_per_customer", r).first()["total_spent"] == Decimal("2700000000000000.22")
    assert plan("q49_customer_spend_rating", r).first()["total_spent"] == Decimal("2700000000000000.22")
    assert plan("q50_spend_above_max_single", r).first()["customer_total_spend"] == Decimal("2700000000000000.22")
    assert plan("q20_profit_loss", replace(r, employee=roles_a.employee.limit(0), purchase=roles_a.purchase.limit(0))).first()[0] is None
    assert plan("v10_top_total_spender", r).schema["sum_total"].dataType.simpleString().startswith("decimal")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_an_amount_that_does_not_fit_fails(spark, ansi):
    from shopfloor.functions.money import money_sum

    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="no amount of money"):
            spark.createDataFrame([(1.0,), (1e30,)], "x double").agg(money_sum("x")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
