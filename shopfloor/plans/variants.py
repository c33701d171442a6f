"""Alternative readings of some questions that give a different result set.

Top-1 answers are made deterministic by a full tie-break order (lowest id
first, then the remaining columns); they are planned as bounded top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions.money import as_money, money_out, money_sum
from shopfloor.operators.extremes import extreme_value, rows_at, top_n
from shopfloor.operators.keep_first import first_per_key
from shopfloor.operators.hot_keys import salted_join
from shopfloor.operators.membership import absent, fact_absent, keys_of, present
from shopfloor.operators.ranking import label_by_position, rank_by_value
from shopfloor.plans.common import SERVICE_ORDER, during
from shopfloor.sources.roles import Roles


def _served_by(r: Roles) -> DataFrame:
    return r.service.join(r.employee.select("eid", "ename", "esal"), "eid")


def v03_zero_comm_rows(r: Roles) -> DataFrame:
    """Employee name and commission of every zero-commission service row (duplicates kept)."""
    return _served_by(r).where(F.col("comm") == 0).select("ename", "comm")


def v03_dedup_by_key(r: Roles) -> DataFrame:
    """One zero-commission row per employee name."""
    return first_per_key(v03_zero_comm_rows(r), ["ename"], ["comm"])


def v03_dedup_by_key_comm(r: Roles) -> DataFrame:
    """One zero-commission row per commission value (the smallest name)."""
    return first_per_key(v03_zero_comm_rows(r), ["comm"], ["ename"])


def _per_employee(r: Roles, *aggs) -> DataFrame:
    """Aggregate service rows per employee id first, then attach the employee."""
    return r.service.groupBy("eid").agg(*aggs).join(r.employee.select("eid", "ename", "esal"), "eid")


def v04_max_comm_per_employee(r: Roles) -> DataFrame:
    """The employee name with the largest single commission (ties → smallest name)."""
    per = _per_employee(r, F.max("comm").alias("_m")).groupBy("ename").agg(F.max("_m").alias("max_comm"))
    return top_n(per, [F.col("max_comm").desc_nulls_last(), F.col("ename").asc()], 1)


def v04_top_total_commission(r: Roles, as_double: bool = False) -> DataFrame:
    """The id of the known employee with the largest total commission (ties → smallest id)."""
    per = r.service.groupBy("eid").agg(money_sum("comm").alias("sum_comm"))
    best = top_n(present(per, r.employee, ["eid"]), [F.col("sum_comm").desc_nulls_last(), F.col("eid").asc()], 1)
    return best.select("eid", money_out("sum_comm", as_double).alias("sum_comm"))


def _top_row(rows: DataFrame, key: str, known: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """The service row with the highest (or lowest) ``value`` among rows whose ``key`` is known, with its ``known`` columns.

    The extreme of each key comes from a hash aggregate, partly before the shuffle, and the extreme over the
    known keys is a scalar; only rows that have it are joined, and the rest of the row settles their ties.
    A row without a value is taken only if no known key has one.
    """
    how = F.max if descending else F.min
    per_key = present(rows.groupBy(key).agg(how(value).alias(value)), known, [key])
    best = extreme_value(per_key, value, "max" if descending else "min")
    hits = rows.where(F.col(value).eqNullSafe(best)).join(known, key)
    names = [c for c in known.columns if c != key]
    return top_n(hits, [F.col(c).asc_nulls_first() for c in SERVICE_ORDER], 1).select(*names, value)


def v04_top1_row(r: Roles) -> DataFrame:
    """Name and commission of the single highest-commission service row."""
    return _top_row(r.service, "eid", r.employee.select("eid", "ename"), "comm")


def v05_min_comm_per_employee(r: Roles) -> DataFrame:
    """Smallest commission per employee name, zeros included."""
    return _per_employee(r, F.min("comm").alias("_m")).groupBy("ename").agg(F.min("_m").alias("min_comm"))


def v05_bottom1_positive(r: Roles) -> DataFrame:
    """Name and commission of the single lowest positive-commission service row."""
    paid = r.service.where(F.col("comm") > 0)
    return _top_row(paid, "eid", r.employee.select("eid", "ename"), "comm", descending=False)


def v06_key_midpoint(r: Roles) -> DataFrame:
    """The part whose id equals floor(avg(id)); empty when that id does not exist."""
    mid = r.part.agg(F.floor(F.avg("spid"))).scalar()
    return r.part.where(F.col("spid") == mid)


def v07_last_n_ascending(r: Roles, n: int = 4) -> DataFrame:
    """The ``n`` parts with the highest ids, listed in ascending id order."""
    return top_n(r.part, [F.col("spid").desc()], n).orderBy("spid")


def v10_top_total_spender(r: Roles, as_double: bool = False) -> DataFrame:
    """The customer name with the largest total spend (ties → smallest name)."""
    per_cid = r.service.groupBy("cid").agg(money_sum("total").alias("_t"))
    per = per_cid.join(r.customer.select("cid", "cname"), "cid") \
        .groupBy("cname").agg(F.sum("_t").alias("sum_total"))
    best = top_n(per, [F.col("sum_total").desc_nulls_last(), F.col("cname").asc()], 1)
    return best.select("cname", money_out("sum_total", as_double).alias("sum_total"))


def v10_top_part_amount(r: Roles) -> DataFrame:
    """Customer and part amount of the single service row with the largest part amount."""
    return _top_row(r.service, "cid", r.customer.select("cid", "cname"), "sp_amt")


def v11_employees_without_service(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Employees who never did a service (in the period)."""
    return absent(r.employee, keys_of(during(r.service, "ser_date", start, end), "eid"), ["eid"]).select("ename")


def v12_service_rows_by_vehicle_type(r: Roles, vehicle_type: str = "TWO WHEELER") -> DataFrame:
    """Number of service rows (not customers) for one vehicle type."""
    return r.service.where(F.col("type_veh") == vehicle_type).groupBy("type_veh") \
        .agg(F.count("*").alias("service_rows"))


def v13_part_usage_counts(r: Roles) -> DataFrame:
    """Number of services per part name."""
    per_part = r.service.groupBy("spid").agg(F.count("*").alias("_n"))
    return per_part.join(r.part.select("spid", "spname"), "spid") \
        .groupBy("spname").agg(F.sum("_n").cast("bigint").alias("usage_count"))


def v15_income_per_service(r: Roles, as_double: bool = False) -> DataFrame:
    """Per service row: the employee's yearly salary plus twelve times that commission."""
    income = money_out(as_money(F.col("esal")) * 12 + as_money(F.col("comm")) * 12, as_double)
    return _served_by(r).select("sid", "ename", income.alias("annual_income"))


def v17_colour_purchase_rows(r: Roles, part_ids: Sequence[int] = (4009, 4010)) -> DataFrame:
    """Part name and total of every purchase of the listed parts."""
    return r.purchase.where(F.col("spid").isin(list(part_ids))).select("spid", "total") \
        .join(r.part.select("spid", "spname"), "spid").select("spname", "total")


def v18_unused_purchase_rows(r: Roles, start: str | None = None, end: str | None = None) -> DataFrame:
    """Whole purchase rows (in the period) of parts never used in a service (in it)."""
    used = keys_of(during(r.service, "ser_date", start, end), "spid")
    return fact_absent(during(r.purchase, "pdate", start, end), used, "spid")


def v20_margin_per_employee(r: Roles, as_double: bool = False) -> DataFrame:
    """Per employee name: Σ (monthly salary − service bill) over their services."""
    # Σ(esal − total) over an employee's n services = n·esal − Σ total (NULL when esal is NULL).
    per = _per_employee(r, F.count("*").alias("_n"), money_sum("total").alias("_t"))
    term = as_money(F.col("esal")) * F.col("_n") - F.col("_t")
    return per.groupBy("ename").agg(money_out(F.sum(term), as_double).alias("margin"))


def v24_top_service_gst(r: Roles) -> DataFrame:
    """Customer and part GST of the single service row with the highest part GST."""
    return _top_row(r.service, "cid", r.customer.select("cid", "cname"), "sp_g")


def v27_vehicle_supply_report(r: Roles, veh_no: str = "MH14PA335") -> DataFrame:
    """For one vehicle: customer, part and every purchase (quantity, date, location) of that part.

    Equal uses are one row with their number ``n_uses``, so the listing is linear in the
    purchases of the vehicle's parts however often one of them was used.
    """
    uses = r.service.where(F.col("veh_no") == veh_no).groupBy("cid", "veh_no", "spid").agg(F.count("*").alias("n_uses"))
    # The vehicle's side is put together first; the purchases then meet it in one join that spreads a hot part.
    named = uses.join(r.customer.select("cid", "cname"), "cid").join(r.part.select("spid", "spname"), "spid")
    buys = salted_join(r.purchase.select("spid", "vid", "pqty", "pdate"), named, "spid", unique=False)
    return (buys.join(r.vendor.select("vid", "vadd"), "vid")
            .select("cname", "veh_no", "spname", "n_uses", "pqty", "pdate", "vadd"))


def v33_dense_rank_services(r: Roles) -> DataFrame:
    """Employees with services, their count and DENSE_RANK by it (highest first)."""
    counts = r.service.groupBy("eid").agg(F.count("*").alias("service_count")) \
        .join(r.employee.select("eid", "ename"), "eid")
    return rank_by_value(counts, "service_count", out="service_dense_rank", method="dense_rank", bounded_values=True) \
        .select("ename", "service_count", "service_dense_rank")


def v35_salary_grade_bands(r: Roles, bands: Sequence[tuple[float, str]] = (
        (1700, "Grade A"), (1500, "Grade B"), (1000, "Grade C"), (500, "Grade D")),
        otherwise: str = "Grade E") -> DataFrame:
    """Salary grade by fixed bands (salary above each limit), highest salary first; NULL → last band."""
    expr = None
    for limit, label in bands:
        hit = F.col("esal") > limit
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return r.employee.select("eid", "ename", "esal", expr.otherwise(otherwise).alias("grade")) \
        .orderBy(F.col("esal").desc_nulls_last(), "ename", "eid").drop("eid")


def v39_same_city_as_employee(r: Roles) -> DataFrame:
    """Services where the customer lives in the serving employee's city."""
    return (r.service.select("sid", "cid", "eid", "veh_no", "typ_ser", "type_veh")
            .join(r.employee.select("eid", "eadd"), "eid")
            .join(r.customer.select("cid", "cname", "cadd"), "cid")
            .where(F.col("eadd") == F.col("cadd"))
            .select("sid", "cname", "cadd", "veh_no", "typ_ser", "type_veh"))


def v40_customers_per_employee(r: Roles) -> DataFrame:
    """Number of service rows with a known customer, per employee."""
    per = r.service.where(F.col("eid").isNotNull()).groupBy("eid", "cid").agg(F.count("*").alias("_n"))
    return present(per, r.customer, ["cid"]).groupBy("eid").agg(F.sum("_n").alias("customer_count"))


def v42_rating_served_only(r: Roles) -> DataFrame:
    """Employees with services rated by count: >3 A, >=2 B, else C."""
    counts = r.service.groupBy("eid").agg(F.count("*").alias("service_count")) \
        .join(r.employee.select("eid", "ename"), "eid")
    c = F.col("service_count")
    return counts.select("ename", "service_count",
                         F.when(c > 3, "A").when(c >= 2, "B").otherwise("C").alias("rating"))


def v43_total_per_customer(r: Roles, as_double: bool = False) -> DataFrame:
    """Total spend per served customer."""
    return r.service.groupBy("cid").agg(money_sum("total").alias("total_spent")) \
        .join(r.customer.select("cid", "cname", "cadd"), "cid").select("cid", "cname", "cadd", money_out("total_spent", as_double).alias("total_spent"))


def v45_location_of_max_total(r: Roles) -> DataFrame:
    """Vendor, location and the part's list rate of the single largest purchase."""
    best = top_n(r.purchase, [F.col("total").desc_nulls_last(), F.col("pid").asc(), F.col("vid").asc(),
                              F.col("spid").asc(), F.col("pdate").asc()], 1)
    return (best.select("vid", "spid").join(r.vendor.select("vid", "vname", "vadd"), "vid")
            .join(r.part.select("spid", "sprate"), "spid").select("vname", "vadd", "sprate"))


def v49_spend_position(r: Roles, labels: Sequence[str] = ("A", "B", "C", "D", "E"), otherwise: str = "F",
                       as_double: bool = False) -> DataFrame:
    """Known customers by ascending spend: positions 1..5 get A..E, the rest F.

    Only the first len(labels) positions matter, so they come from a bounded
    top-k; every other customer gets ``otherwise``.
    """
    spend = present(r.service.groupBy("cid").agg(money_sum("total").alias("total_spent")), r.customer, ["cid"])
    k = len(labels)
    first = top_n(spend, [F.col("total_spent").asc_nulls_last(), F.col("cid").asc()], k)
    # The window below runs over the at most k rows of the top-k.
    first = first.select("cid", F.row_number().over(
        Window.orderBy(F.col("total_spent").asc_nulls_last(), F.col("cid").asc())).alias("_pos"))
    return spend.join(F.broadcast(first), "cid", "left").select(
        "cid", money_out("total_spent", as_double).alias("total_spent"), label_by_position(F.col("_pos"), list(labels), otherwise).alias("spend_grade"))


def v56_first_hired(r: Roles) -> DataFrame:
    """Employees with the earliest joining date (ties kept)."""
    return rows_at(r.employee, "edoj", "min").select("ename", "edoj")


VARIANTS = {name: fn for name, fn in dict(globals()).items() if name[:1] == "v" and name[1:3].isdigit()}
