"""The sixty-one workshop questions as lazy DataFrame plans.

Every function takes the six :class:`~shopfloor.sources.roles.Roles` plus the
question's literals as keyword arguments (defaults are the literals of the
original workshop data set) and returns one DataFrame. Nothing is collected:
scalars such as "the maximum commission" are scalar subqueries that Catalyst
runs once, and every aggregate is a hash aggregate with map-side partial
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.dates import day_is_even, day_is_odd
from shopfloor.functions.money import as_money, money_out, money_sum
from shopfloor.functions.words import amount_in_words
from shopfloor.operators.cooccurrence import group_partners
from shopfloor.operators.extremes import extreme_value, nth_by, rows_at, top_n
from shopfloor.operators.keep_first import first_per_key
from shopfloor.operators.many_to_many import summarise_matches
from shopfloor.operators.membership import absent, fact_present, keys_of, present
from shopfloor.operators.positions import select_nth
from shopfloor.operators.ranking import grade_by_dense_rank, rank_by_value
from shopfloor.plans.common import PURCHASE_ORDER, SERVICE_ORDER, asc, during
from shopfloor.sources.roles import Roles


def _names(r: Roles) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Narrow dimension projections used by most questions."""
    return (r.customer.select("cid", "cname"), r.employee.select("eid", "ename"),
            r.part.select("spid", "spname"), r.vendor.select("vid", "vname"))


# --- who was and was not served -------------------------------------------

def q01_serviced_customers(r: Roles) -> DataFrame:
    """Names of customers with at least one service (semi join, then distinct)."""
    return present(r.customer, keys_of(r.service, "cid"), ["cid"]).select("cname").distinct()


def q02_unserviced_customers(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Names of customers with no service in the period (anti join; NULL service.cid does not empty it)."""
    served = during(r.service, "ser_date", start, end)
    return absent(r.customer, keys_of(served, "cid"), ["cid"]).select("cname")


def q03_employees_zero_comm(r: Roles) -> DataFrame:
    """Employees with at least one service that earned no commission."""
    zero = keys_of(r.service.where(F.col("comm") == 0), "eid")
    return present(r.employee, zero, ["eid"]).select("ename").distinct()


def q04_max_commission_employee(r: Roles) -> DataFrame:
    """Employee name for every service row at the highest commission (ties kept)."""
    _, emp, _, _ = _names(r)
    top = rows_at(r.service, "comm", "max").select("eid")
    return top.join(emp, "eid").select("ename")


def q05_min_positive_commission(r: Roles) -> DataFrame:
    """Employee name and commission of service rows at the lowest positive commission."""
    _, emp, _, _ = _names(r)
    low = rows_at(r.service, "comm", "min", where=F.col("comm") > 0).select("eid", "comm")
    return low.join(emp, "eid").select("ename", "comm")


def q06_middle_record(r: Roles, order: Sequence[str] = tuple(SERVICE_ORDER)) -> DataFrame:
    """The middle service row by key: position ceil(n/2) (the lower middle when n is even)."""
    n = r.service.agg(F.count("*")).scalar()
    return select_nth(r.service, list(order), F.ceil(n / 2))


def q07_last_n_records(r: Roles, n: int = 4) -> DataFrame:
    """The ``n`` employees with the highest ids, highest first (bounded top-k)."""
    return top_n(r.employee, [F.col("eid").desc()], n)


def q08_row_count_no_count(r: Roles) -> DataFrame:
    """Number of employee rows without COUNT: SUM(1) (NULL for an empty table)."""
    return r.employee.agg(F.sum(F.lit(1)).cast("bigint").alias("record_count"))


def q09_first_service_per_customer(r: Roles) -> DataFrame:
    """One service row per customer: the one with the lowest sid (rest of the row breaks ties)."""
    return first_per_key(r.service, ["cid"], SERVICE_ORDER).select(*r.service.columns)


def q10_max_single_payment_customer(r: Roles) -> DataFrame:
    """Customer name for each service row at the highest bill (ties kept)."""
    cust, _, _, _ = _names(r)
    return rows_at(r.service, "total", "max").select("cid").join(cust, "cid").select("cname")


def q11_left_employees(r: Roles) -> DataFrame:
    """Employees who have left (leaving date present)."""
    return r.employee.where(F.col("edol").isNotNull()).select("ename")


def q12_two_wheeler_customers(r: Roles, vehicle_type: str = "TWO WHEELER") -> DataFrame:
    """Number of distinct customers who serviced a vehicle of the type (case-insensitive)."""
    hit = r.service.where(F.lower(F.col("type_veh")) == vehicle_type.lower())
    return hit.agg(F.count_distinct("cid").alias("two_wheeler_customers"))


def q13_parts_used_in_service(r: Roles) -> DataFrame:
    """Name and unit of every part used in at least one service."""
    return present(r.part, keys_of(r.service, "spid"), ["spid"]).select("spname", "spunit").distinct()


def q14_colour_customers(r: Roles, service_type: str = "COLOR") -> DataFrame:
    """Customers who had a service of the type (case-insensitive)."""
    hit = keys_of(r.service.where(F.lower(F.col("typ_ser")) == service_type.lower()), "cid")
    return present(r.customer, hit, ["cid"]).select("cname").distinct()


def q15_annual_income(r: Roles, as_double: bool = False) -> DataFrame:
    """Every employee: 12 monthly salaries plus all commissions (0 if none); NULL salary → NULL."""
    comm = r.service.groupBy("eid").agg(money_sum("comm").alias("total_comm"))
    income = as_money(F.col("esal")) * 12 + F.coalesce(F.col("total_comm"), F.lit(0).cast("decimal(34,6)"))
    return (r.employee.join(comm, "eid", "left")
            .select("ename", money_out(income, as_double).alias("annual_income")))


# --- parts, purchasing and vendors ---------------------------------------

def q16_vendors_by_part_name(r: Roles, pattern: str = "%ENGINE OIL%") -> DataFrame:
    """Vendors who supplied a part whose name matches ``pattern`` (SQL LIKE)."""
    parts = r.part.where(F.col("spname").like(pattern)).select("spid")
    vids = keys_of(present(r.purchase, parts, ["spid"]), "vid")
    return present(r.vendor, vids, ["vid"]).select("vname").distinct()


def q17_purchase_cost_by_part_name(r: Roles, pattern: str = "%COLOUR%", as_double: bool = False) -> DataFrame:
    """Total purchase cost per part name for names matching ``pattern``."""
    parts = r.part.where(F.col("spname").like(pattern)).select("spid", "spname")
    # All purchases are summed per part first, partly before the shuffle, so a hot part is one row in the join.
    per_part = r.purchase.groupBy("spid").agg(money_sum("total").alias("_t"))
    return (per_part.join(parts, "spid")
            .groupBy("spname").agg(money_out(F.sum("_t"), as_double).alias("total_purchase_cost")))


def q18_purchased_unused_parts(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parts bought at least once in the period and never used in a service in it (one row per part)."""
    bought = present(r.part, keys_of(during(r.purchase, "pdate", start, end), "spid"), ["spid"])
    return absent(bought, keys_of(during(r.service, "ser_date", start, end), "spid"), ["spid"]).select("spname")


def q19_parts_never_purchased(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parts never bought in the period (anti join; unlike NOT IN, a NULL purchase.spid does not empty it)."""
    return absent(r.part, keys_of(during(r.purchase, "pdate", start, end), "spid"), ["spid"]).select("spname")


def q20_profit_loss(r: Roles, as_double: bool = False) -> DataFrame:
    """Service income minus (one month of all salaries + all purchase cost), exact."""
    revenue = r.service.agg(money_sum("total")).scalar()
    salaries = r.employee.agg(money_sum("esal")).scalar()
    bought = r.purchase.agg(money_sum("total")).scalar()
    spark = r.service.sparkSession
    return spark.range(1).select(money_out(revenue - (salaries + bought), as_double).alias("profit_or_loss"))


def q21_repeat_customers(r: Roles, more_than: int = 1) -> DataFrame:
    """Customers with more than ``more_than`` services (grouped by customer id)."""
    repeat = r.service.groupBy("cid").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return repeat.join(r.customer.select("cid", "cname"), "cid").select("cname")


def q22_items_by_location(r: Roles) -> DataFrame:
    """Vendor location and part name of every purchase, ordered by location."""
    _, _, part, _ = _names(r)
    # The purchase columns complete the sort key: range partitioning can then split a
    # location/item that holds a large share of all purchases over many tasks.
    rows = r.purchase.join(r.vendor.select("vid", "vadd"), "vid").join(part, "spid")
    return (rows.orderBy("vadd", "spname", *asc(PURCHASE_ORDER))
            .select(F.col("vadd").alias("location"), F.col("spname").alias("item_name")))


def q23_count_by_vehicle_type(r: Roles) -> DataFrame:
    """Number of service rows per vehicle type."""
    return r.service.groupBy("type_veh").agg(F.count("*").alias("service_count"))


def q24_customers_of_max_gst_part(r: Roles) -> DataFrame:
    """Customer and part for services using a part that was bought at the highest GST."""
    cust, _, part, _ = _names(r)
    hot = keys_of(rows_at(r.purchase, "spgst", "max"), "spid")
    # Distinct first: a hot part is one row per customer by the time it meets the join.
    used = fact_present(r.service.select("cid", "spid").distinct(), hot, "spid")
    return used.join(cust, "cid").join(part, "spid").select("cname", "spname").distinct()


def q25_vendor_of_max_gst(r: Roles) -> DataFrame:
    """Vendor and part of every purchase at the highest GST."""
    _, _, part, vend = _names(r)
    top = rows_at(r.purchase, "spgst", "max").select("vid", "spid")
    return top.join(vend, "vid").join(part, "spid").select("vname", "spname")


def q26_employee_item_pairs(r: Roles) -> DataFrame:
    """Distinct (employee, part) pairs that occur in services."""
    _, emp, part, _ = _names(r)
    pairs = r.service.select("eid", "spid").distinct()
    return pairs.join(emp, "eid").join(part, "spid").select("ename", "spname").distinct()


def q27_service_supply_report(r: Roles) -> DataFrame:
    """Customer, vehicle and part of each service, with the supply record of that part.

    Every use of a part matches every purchase of it; the listing of all
    combinations is quadratic in a heavily used part. Each distinct
    (customer, vehicle, part) is therefore returned once with the facts of its
    distinct supply records (purchase date, vendor, location): how many there
    are, the first and last purchase date and the number of vendors. Uses of
    parts that were never bought are dropped, as in the inner join.
    """
    cust, _, part, _ = _names(r)
    uses = r.service.select("cid", "veh_no", "spid").distinct()
    supply = (r.purchase.select("spid", "pdate", "vid")
              .join(r.vendor.select("vid", "vname", "vadd"), "vid")
              .select("spid", "pdate", "vid", "vname", "vadd").distinct())
    cols = ["cname", "veh_no", "spid", "spname", "n_supply_records", "first_pdate", "last_pdate", "n_vendors"]
    # The summary columns depend on spid only, so the final distinct is over (cname, veh_no, spid).
    return summarise_matches(uses, supply, "spid", [
        F.count("*").alias("n_supply_records"),
        F.min("pdate").alias("first_pdate"),
        F.max("pdate").alias("last_pdate"),
        F.count_distinct("vid").alias("n_vendors"),
    ], right_extra=part).join(cust, "cid").select(*cols).distinct()


def q27_supply_records(r: Roles) -> DataFrame:
    """The distinct supply records of every part: date, vendor and location of its purchases.

    With the report of :func:`q27_service_supply_report` this is the whole listing, in a size
    linear in the purchases.
    """
    _, _, part, _ = _names(r)
    bought = r.purchase.select("spid", "pdate", "vid").distinct()
    return (bought.join(r.vendor.select("vid", "vname", "vadd"), "vid").join(part, "spid")
            .select("spid", "spname", "pdate", "vname", "vadd").distinct())


def q28_vehicle_owner(r: Roles, veh_no: str = "MH14PA335") -> DataFrame:
    """Owner of a vehicle (one row per service of it)."""
    cust, _, _, _ = _names(r)
    return r.service.where(F.col("veh_no") == veh_no).select("cid").join(cust, "cid").select("cname")


def q29_city_service_dates(r: Roles, city: str = "NEW YORK") -> DataFrame:
    """Customers of one city and the dates of their services."""
    local = r.customer.where(F.col("cadd") == city).select("cid", "cname")
    return local.join(r.service.select("cid", "ser_date"), "cid").select("cname", "ser_date")


def q30_vendor_of_max_purchase(r: Roles) -> DataFrame:
    """Vendor of each purchase at the highest total (ties kept)."""
    _, _, _, vend = _names(r)
    return rows_at(r.purchase, "total", "max").select("vid").join(vend, "vid").select("vname")


# --- employees ------------------------------------------------------------

def q31_non_mechanic_servers(r: Roles, job: str = "MECHANIC") -> DataFrame:
    """Employees not in ``job`` who did at least one service."""
    others = r.employee.where(F.col("ejob") != job)
    return present(others, keys_of(r.service, "eid"), ["eid"]).select("ename").distinct()


def q32_jobs_with_min_employees(r: Roles, more_than: int = 1) -> DataFrame:
    """Jobs held by more than ``more_than`` employees."""
    return (r.employee.groupBy("ejob").agg(F.count("*").alias("employee_count"))
            .where(F.col("employee_count") > more_than))


def _service_counts(r: Roles) -> DataFrame:
    return r.service.groupBy("eid").agg(F.count("*").alias("service_count"))


def q33_rank_employees_by_services(r: Roles) -> DataFrame:
    """Employees with services, their service count and RANK by it (highest first)."""
    counts = _service_counts(r).join(r.employee.select("eid", "ename", "ejob"), "eid")
    return rank_by_value(counts, "service_count", out="service_rank", method="rank", bounded_values=True) \
        .select("ename", "ejob", "service_count", "service_rank")


def q34_service_count_by_job_filter(r: Roles, jobs: Sequence[str] = ("PAINTER", "FITTER")) -> DataFrame:
    """Service count per employee (by id) for employees in the given jobs who served."""
    staff = r.employee.where(F.col("ejob").isin(list(jobs))).select("eid", "ename", "ejob")
    return _service_counts(r).join(staff, "eid").select("ename", "ejob", "service_count")


def q35_salary_grade_rank(r: Roles, bands: Sequence[tuple[int, str]] = ((2, "A"), (4, "B")),
                          otherwise: str = "C") -> DataFrame:
    """Salary grade from the dense rank of salary (highest first, NULL last)."""
    emp = r.employee.select("ename", "esal")
    return grade_by_dense_rank(emp, "esal", list(bands), otherwise, out="salary_grade")


def q36_nth_record(r: Roles, n: int = 4) -> DataFrame:
    """The ``n``-th employee by id (bounded top-n, then the last of them)."""
    return nth_by(r.employee, [F.col("eid").asc()], n)


def q37_default_commission(r: Roles, default: int = 100) -> DataFrame:
    """Each service's commission, with 0 or missing replaced by ``default``."""
    new = F.when(F.col("comm").isNull() | (F.col("comm") == 0), F.lit(default)).otherwise(F.col("comm"))
    return r.service.select("sid", "eid", "comm", new.alias("new_commission"))


def q38_services_per_day(r: Roles) -> DataFrame:
    """Number of services per day, busiest first."""
    return (r.service.groupBy("ser_date").agg(F.count("*").alias("number_of_services"))
            .orderBy(F.col("number_of_services").desc(), F.col("ser_date")))


def q39_services_shared_city(r: Roles, more_than: int = 1) -> DataFrame:
    """Service rows of customers whose city has more than ``more_than`` customers."""
    cities = r.customer.groupBy("cadd").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("cadd")
    members = present(r.customer.select("cid", "cadd"), cities, ["cadd"]).select("cid")
    return present(r.service, members, ["cid"])


def q40_customer_pairs_same_employee(r: Roles) -> DataFrame:
    """Customer pairs served by one employee, factorised.

    One row per (employee, customer) with ``n_partners`` = other customers of
    that employee: every two customers of an employee form a pair, so this is
    the pair set without its quadratic listing (Σ n_partners / 2 pairs).
    """
    cust, _, _, _ = _names(r)
    return group_partners(r.service, "eid", "cid").join(cust, "cid").select("eid", "cid", "cname", "n_partners")


def q41_service_customer_list(r: Roles) -> DataFrame:
    """Each service id with its customer's name."""
    cust, _, _, _ = _names(r)
    return r.service.select("sid", "cid").join(cust, "cid").select("sid", "cname")


def q42_employee_rating(r: Roles) -> DataFrame:
    """Every employee's service count (0 if none) and a rating: >=3 A, 2 B, 1 C, else D."""
    counts = r.employee.select("eid", "ename", "ejob").join(_service_counts(r), "eid", "left") \
        .withColumn("service_count", F.coalesce(F.col("service_count"), F.lit(0).cast("bigint")))
    c = F.col("service_count")
    rating = F.when(c >= 3, "A").when(c == 2, "B").when(c == 1, "C").otherwise("D")
    return counts.select("ename", "ejob", "service_count", rating.alias("rating"))


# --- customers and money --------------------------------------------------

def q43_max_service_per_customer(r: Roles) -> DataFrame:
    """Customer details with their highest single service bill (served customers only)."""
    best = r.service.groupBy("cid").agg(F.max("total").alias("max_service_amount"))
    return r.customer.join(best, "cid")


def q44_service_count_per_customer(r: Roles) -> DataFrame:
    """Customer details with their number of services (0 for none; other NULLs untouched)."""
    counts = r.service.groupBy("cid").agg(F.count("*").alias("total_services"))
    return r.customer.join(counts, "cid", "left") \
        .withColumn("total_services", F.coalesce(F.col("total_services"), F.lit(0).cast("bigint")))


def q45_location_of_max_rate(r: Roles) -> DataFrame:
    """Vendor location of each purchase at the highest unit rate."""
    return rows_at(r.purchase, "sprate", "max").select("vid").join(r.vendor.select("vid", "vadd"), "vid") \
        .select("vadd")


def q46_null_salary_services(r: Roles) -> DataFrame:
    """Employees without a salary, with all their service rows."""
    staff = r.employee.where(F.col("esal").isNull()).select("eid", "ename", "ejob")
    return staff.join(r.service, "eid").select("ename", "ejob", *r.service.columns)


def _purchase_by_location(r: Roles, out: str, as_double: bool) -> DataFrame:
    # Sum per vendor first (exact decimals), so the join sees one row per vendor.
    per_vendor = r.purchase.groupBy("vid").agg(money_sum("total").alias("_t"))
    return (per_vendor.join(r.vendor.select("vid", "vadd"), "vid")
            .groupBy("vadd").agg(money_out(F.sum("_t"), as_double).alias(out)))


def q47_purchase_total_by_location(r: Roles, as_double: bool = False) -> DataFrame:
    """Total purchase cost per vendor location."""
    return _purchase_by_location(r, "total_purchase_amount", as_double)


def q48_purchase_total_in_words(r: Roles, as_double: bool = False) -> DataFrame:
    """Purchase total per location, with its whole part spelled in English words."""
    return _purchase_by_location(r, "total_amount", as_double) \
        .withColumn("amount_in_words", amount_in_words("total_amount"))


def _spend(r: Roles) -> DataFrame:
    return r.service.groupBy("cid").agg(money_sum("total").alias("total_spent"))


def q49_customer_spend_rating(r: Roles, bands: Sequence[tuple[int, str]] = ((1, "A"), (3, "B")),
                              otherwise: str = "C", as_double: bool = False) -> DataFrame:
    """Spend per customer rated by dense rank of spend: 1 → A, <=3 → B, else C; biggest first."""
    rated = grade_by_dense_rank(_spend(r), "total_spent", list(bands), otherwise, out="rating")
    # The null-safe join puts no filter below the sums, so rows and thresholds share one aggregate of the fact.
    known = r.customer.where(F.col("cid").isNotNull()).select(F.col("cid").alias("_cid"), "cname")
    return rated.join(known, F.col("cid").eqNullSafe(F.col("_cid"))) \
        .select("cid", "cname", money_out("total_spent", as_double).alias("total_spent"), "rating").orderBy(F.col("total_spent").desc(), "cid")


def q50_spend_above_max_single(r: Roles, as_double: bool = False) -> DataFrame:
    """Customers whose total spend exceeds the largest single service bill."""
    biggest = as_money(extreme_value(r.service, "total", "max"))
    spend = r.service.groupBy("cid").agg(money_sum("total").alias("customer_total_spend"))
    return spend.where(F.col("customer_total_spend") > biggest) \
        .join(r.customer.select("cid", "cname"), "cid").select("cname", money_out("customer_total_spend", as_double).alias("customer_total_spend"))


def q51_customer_part_vehicle(r: Roles) -> DataFrame:
    """Customer, part used and vehicle type of every service."""
    cust, _, part, _ = _names(r)
    return r.service.select("cid", "spid", "type_veh").join(cust, "cid").join(part, "spid") \
        .select("cname", "spname", "type_veh")


def q52_service_breakdown(r: Roles) -> DataFrame:
    """Part, employee, customer, quantity, rate and service amount of every service."""
    cust, emp, part, _ = _names(r)
    return (r.service.select("cid", "eid", "spid", "qty", "sp_rate", "ser_amt")
            .join(part, "spid").join(emp, "eid").join(cust, "cid")
            .select("spname", "ename", "cname", "qty", "sp_rate", "ser_amt"))


def q53_owners_by_service_type(r: Roles, service_type: str = "TUBE DAMAGED") -> DataFrame:
    """Distinct customers who had a service of the given type."""
    hit = keys_of(r.service.where(F.col("typ_ser") == service_type), "cid")
    return present(r.customer, hit, ["cid"]).select("cname").distinct()


def q54_full_service_details(r: Roles, service_type: str = "FULL SERVICING") -> DataFrame:
    """Customer, city, vehicle and date of every service of the given type."""
    hit = r.service.where(F.col("typ_ser") == service_type).select("cid", "veh_no", "ser_date")
    return hit.join(r.customer.select("cid", "cname", "cadd"), "cid").select("cname", "cadd", "veh_no", "ser_date")


def q55_left_without_service(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Employees who left without ever doing a service (in the period)."""
    gone = r.employee.where(F.col("edol").isNotNull())
    return absent(gone, keys_of(during(r.service, "ser_date", start, end), "eid"), ["eid"]).select("ename")


def q56_first_service_employee(r: Roles) -> DataFrame:
    """Employees of the services on the earliest calendar date."""
    _, emp, _, _ = _names(r)
    return rows_at(r.service, "ser_date", "min").select("eid").join(emp, "eid").select("ename")


def q57_odd_day_services(r: Roles) -> DataFrame:
    """Service rows dated on an odd day of the month."""
    return r.service.where(day_is_odd(F.col("ser_date")))


def q58_even_day_services(r: Roles) -> DataFrame:
    """Service rows dated on an even day of the month."""
    return r.service.where(day_is_even(F.col("ser_date")))


def q59_vendors_with_unused_parts(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Vendors who sold (in the period) at least one part that was never used in a service (in it).

    The anti join runs over distinct (vendor, part) pairs, so a part with a third of all
    purchases is one row per vendor by then.
    """
    sold = keys_of(during(r.purchase, "pdate", start, end), "vid", "spid")
    unused = absent(sold, keys_of(during(r.service, "ser_date", start, end), "spid"), ["spid"])
    return present(r.vendor, keys_of(unused, "vid"), ["vid"]).select("vname")


def q60_part_age_at_use(r: Roles) -> DataFrame:
    """Days between buying and using a part, summarised per service.

    Each service row is matched with every purchase of its part; the per-pair
    listing is quadratic in a heavily traded part, so each service row gets
    the exact facts of its pairs instead: the number of purchases, the
    smallest and largest day difference (use date − purchase date; negative
    when the purchase came after the use) and the sum of all differences.
    Services whose part was never bought are dropped, as in the inner join.
    """
    _, _, part, _ = _names(r)
    epoch_day = F.unix_date(F.col("pdate")).cast("bigint")
    per_service = summarise_matches(r.service, r.purchase.select("spid", "pdate"), "spid", [
        F.count("*").alias("n_purchases"),
        F.count("pdate").alias("_n_dated"),
        F.min("pdate").alias("_first"),
        F.max("pdate").alias("_last"),
        F.sum(epoch_day).alias("_sum_day"),
    ], right_extra=part)
    use_day = F.unix_date(F.col("ser_date")).cast("bigint")
    return per_service.select(
        *r.service.columns, "spname", "n_purchases",
        F.datediff("ser_date", "_last").cast("bigint").alias("min_days"),
        F.datediff("ser_date", "_first").cast("bigint").alias("max_days"),
        (use_day * F.col("_n_dated") - F.col("_sum_day")).alias("total_days"),
    )


def q61_services_in_date_range(r: Roles, start: str = "2011-01-04", end: str = "2011-10-21") -> DataFrame:
    """Service rows dated within [start, end] (inclusive, calendar dates)."""
    return r.service.where(F.col("ser_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


QUESTIONS = {name: fn for name, fn in dict(globals()).items() if name[:1] == "q" and name[1:3].isdigit()}
