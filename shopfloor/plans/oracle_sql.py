"""Independent SQL for every registered question.

Each question is answered the direct way in SQL, by another method than its plan, including
the quadratic pair listings (q27, q40, q60) that the DataFrame plans
factorise, so the SQL checks the factorisation against brute force.

:func:`oracle_queries` gives DuckDB statements straight over the raw warehouse tables (the
driver's correctness oracle); none goes through a mapping of the roles.

Column names and types match the DataFrame results (counts and day
differences BIGINT, money summed as DECIMAL(18,2) and returned as DOUBLE).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from shopfloor.plans.catalog import ALL, WAREHOUSE_PARAMS
from shopfloor.plans.common import SERVICE_ORDER


def _default(name: str, key: str):
    return inspect.signature(ALL[name]).parameters[key].default


def _lit_list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _statements(resolve: Callable[[str, str], object]) -> dict[str, str]:
    """Statements straight over the warehouse tables, each from the question's definition."""
    done, bought = "l_linestatus = 'F'", "l_linestatus = 'O'"

    def week(name: str, column: str) -> str:
        return f"CAST({column} AS DATE) BETWEEN DATE '{resolve(name, 'start')}' AND DATE '{resolve(name, 'end')}'"

    def finished(name: str, key: str) -> str:  # keys with a finished line ordered in the period
        return f"SELECT {key} FROM lineitem, orders WHERE l_orderkey = o_orderkey AND {done} AND {week(name, 'o_orderdate')}"

    def shipped(name: str, key: str) -> str:  # keys with an open line shipped in the period
        return f"SELECT {key} FROM lineitem WHERE {bought} AND {week(name, 'l_shipdate')}"

    row = """l_orderkey AS sid, o_custkey AS cid, l_suppkey AS eid, l_partkey AS spid, l_returnflag AS type_veh,
               concat('V', o_orderkey) AS veh_no, o_orderpriority AS typ_ser, CAST(o_orderdate AS DATE) AS ser_date,
               l_quantity AS qty, l_extendedprice / l_quantity AS sp_rate, l_extendedprice AS sp_amt,
               abs(l_tax) AS sp_g, l_extendedprice AS ser_amt, abs(l_discount) AS comm, l_extendedprice AS total"""
    middle = f"""
        SELECT {row}
        FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_linestatus = 'F'
        QUALIFY row_number() OVER (ORDER BY sid, cid, eid, spid, type_veh, veh_no, typ_ser, ser_date, qty, sp_rate, sp_amt, sp_g, comm)
                = (SELECT (count(*) + 1) // 2 FROM lineitem WHERE l_linestatus = 'F')"""
    vehicle = resolve("v27_vehicle_supply_report", "veh_no")
    jobs = _lit_list(resolve("q34_service_count_by_job_filter", "jobs"))
    # Spelled by arithmetic on the powers of a thousand, with words typed here once more.
    spelled = """
        WITH sums AS (SELECT n_name AS vadd, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS total
                      FROM lineitem, supplier, nation
                      WHERE l_linestatus = 'O' AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey GROUP BY 1),
        parts AS (SELECT vadd, total, i, CAST(floor(total) AS BIGINT) // CAST(1000 ** i AS BIGINT) % 1000 AS g FROM sums, range(5) AS t(i)),
        cut AS (SELECT vadd, total, i, g // 100 AS h, g % 100 AS r FROM parts WHERE g > 0),
        lists AS (SELECT ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen',
                          'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS ones,
                         ['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS tens,
                         [' thousand', ' million', ' billion', ' trillion'] AS powers),
        said AS (SELECT vadd, total, i, h, concat(
                     CASE WHEN h > 0 THEN concat(ones[h], ' hundred') END, CASE WHEN h > 0 AND r > 0 THEN ' and ' END,
                     CASE WHEN r BETWEEN 1 AND 19 THEN ones[r] WHEN r > 0 THEN concat(tens[r // 10 - 1], CASE WHEN r % 10 > 0 THEN concat('-', ones[r % 10]) END) END,
                     CASE WHEN i > 0 THEN powers[i] END) AS w FROM cut, lists),
        glued AS (SELECT vadd, total, w, i, CASE WHEN i = max(i) OVER (PARTITION BY vadd) THEN '' WHEN i = 0 AND h = 0 THEN ' and ' ELSE ', ' END AS glue FROM said)
        SELECT vadd, CAST(total AS DOUBLE) AS total_amount, string_agg(concat(glue, w), '' ORDER BY i DESC) AS amount_in_words FROM glued GROUP BY vadd, total"""
    cents = "CAST(l_extendedprice AS DECIMAL(18, 2))"
    spend = f"WITH spend AS (SELECT o_custkey AS k, sum({cents}) AS t FROM orders, lineitem WHERE o_orderkey = l_orderkey AND {done} GROUP BY 1)"
    crowded = resolve("q39_services_shared_city", "more_than")
    per_supplier = f"SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE {done} GROUP BY l_suppkey"
    staff = """s_suppkey AS eid, s_name AS ename, r_name AS ejob, n_name AS eadd, if(s_acctbal >= 0, s_acctbal, NULL) AS esal,
               CAST(DATE '1990-01-01' + CAST(floor(abs(s_acctbal)) AS INTEGER) AS DATE) AS edoj, if(s_acctbal < 2000, DATE '2001-12-31', NULL) AS edol"""
    hired = "supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey"
    pay = "SELECT s_name AS ename, if(s_acctbal >= 0, s_acctbal, NULL) AS esal FROM supplier SEMI JOIN nation ON s_nationkey = n_nationkey"
    buyer = "c_custkey AS cid, c_name AS cname, n_name AS cadd"
    piece = "p_partkey AS spid, p_name AS spname, p_retailprice AS sprate, p_brand AS spunit"
    uses = f"SELECT {row} FROM lineitem, orders WHERE l_orderkey = o_orderkey AND {done}"
    worked = f"lineitem, supplier WHERE l_suppkey = s_suppkey AND {done}"
    whole_row = ", ".join(SERVICE_ORDER)

    def top_use(column: str, order: str, name: str, table: str, key: str, where: str = "true") -> str:  # the first row in that order
        return f"SELECT {name}, {column} FROM (SELECT * FROM ({uses}) WHERE {where} QUALIFY row_number() OVER (ORDER BY {column} {order}, {whole_row}) = 1), {table} WHERE {key}"

    bands = " ".join(f"WHEN esal > {limit} THEN '{label}'" for limit, label in resolve("v35_salary_grade_bands", "bands"))
    part_ids = _lit_list(resolve("v17_colour_purchase_rows", "part_ids"))
    return {
        "q07_last_n_records": f"SELECT {staff} FROM {hired} QUALIFY row_number() OVER (ORDER BY s_suppkey DESC) <= 4",
        "q08_row_count_no_count": f"SELECT count(s_suppkey) AS record_count FROM {hired}",
        "q09_first_service_per_customer": f"SELECT unnest(least_row) FROM (SELECT min(t) AS least_row FROM ({uses}) AS t GROUP BY t.cid)",
        "q11_left_employees": "SELECT s_name AS ename FROM supplier SEMI JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 2000",
        "q12_two_wheeler_customers": f"SELECT count(*) AS two_wheeler_customers FROM customer SEMI JOIN (SELECT o_custkey FROM orders, lineitem WHERE o_orderkey = l_orderkey AND {done} AND l_returnflag ILIKE '{resolve('q12_two_wheeler_customers', 'vehicle_type')}') ON c_custkey = o_custkey",
        # All money as one signed ledger.
        "q20_profit_loss": f"SELECT CAST(sum(a) AS DOUBLE) AS profit_or_loss FROM (SELECT if({done}, 1, -1) * {cents} AS a FROM lineitem WHERE l_linestatus IN ('F', 'O') UNION ALL SELECT -CAST(s_acctbal AS DECIMAL(18, 2)) FROM supplier WHERE s_acctbal >= 0)",
        "q27_service_supply_report": f"""SELECT c_name AS cname, concat('V', o_orderkey) AS veh_no, p_partkey AS spid, p_name AS spname, count(DISTINCT (CAST(b.l_shipdate AS DATE), b.l_suppkey)) AS n_supply_records,
               min(CAST(b.l_shipdate AS DATE)) AS first_pdate, max(CAST(b.l_shipdate AS DATE)) AS last_pdate, count(DISTINCT b.l_suppkey) AS n_vendors
            FROM lineitem AS u, lineitem AS b, orders, customer, part
            WHERE u.l_partkey = b.l_partkey AND u.{done} AND b.{bought} AND u.l_orderkey = o_orderkey AND o_custkey = c_custkey AND u.l_partkey = p_partkey GROUP BY 1, 2, 3, 4""",
        "q35_salary_grade_rank": f"WITH pay AS ({pay}), best AS (SELECT list_reverse_sort(list(DISTINCT esal) FILTER (esal IS NOT NULL)) AS v FROM pay) SELECT ename, esal, CASE WHEN esal >= v[2] THEN 'A' WHEN esal >= v[4] THEN 'B' ELSE 'C' END AS salary_grade FROM pay, best",
        "q36_nth_record": f"SELECT {staff} FROM {hired} QUALIFY row_number() OVER (ORDER BY s_suppkey) = 4",
        "q38_services_per_day": f"SELECT CAST(o_orderdate AS DATE) AS ser_date, CAST(sum(n) AS BIGINT) AS number_of_services FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE {done} GROUP BY 1), orders WHERE k = o_orderkey GROUP BY 1",
        "q40_customer_pairs_same_employee": f"WITH u AS (SELECT DISTINCT l_suppkey AS eid, o_custkey AS cid FROM lineitem, orders WHERE l_orderkey = o_orderkey AND {done}) SELECT a.eid, a.cid, c_name AS cname, count(b.cid) AS n_partners FROM u AS a LEFT JOIN u AS b ON a.eid = b.eid AND a.cid <> b.cid, customer WHERE a.cid = c_custkey GROUP BY 1, 2, 3",
        "q43_max_service_per_customer": f"SELECT {buyer}, c_mktsegment AS gender, max(l_extendedprice) AS max_service_amount FROM customer, nation, orders, lineitem WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND {done} GROUP BY ALL",
        "q44_service_count_per_customer": f"SELECT {buyer}, c_mktsegment AS gender, count(o_custkey) AS total_services FROM (SELECT o_custkey FROM orders, lineitem WHERE o_orderkey = l_orderkey AND {done}) RIGHT JOIN customer ON o_custkey = c_custkey, nation WHERE c_nationkey = n_nationkey GROUP BY ALL",
        "q57_odd_day_services": f"{uses} AND right(strftime(CAST(o_orderdate AS DATE), '%d'), 1) IN ('1', '3', '5', '7', '9')",
        "q58_even_day_services": f"{uses} AND right(strftime(CAST(o_orderdate AS DATE), '%d'), 1) IN ('0', '2', '4', '6', '8')",
        "q60_part_age_at_use": f"""WITH u AS (SELECT row_number() OVER () AS r, * FROM ({uses})),
            ages AS (SELECT r, ser_date - CAST(l_shipdate AS DATE) AS days FROM u, lineitem WHERE spid = l_partkey AND {bought}),
            sums AS (SELECT r, count(*) AS n_purchases, min(days) AS min_days, max(days) AS max_days, CAST(sum(days) AS BIGINT) AS total_days FROM ages GROUP BY r)
            SELECT {whole_row}, p_name AS spname, n_purchases, min_days, max_days, total_days FROM u JOIN sums USING (r), part WHERE spid = p_partkey""",
        "q61_services_in_date_range": f"{uses} AND {week('q61_services_in_date_range', 'o_orderdate')}",
        "v03_zero_comm_rows": f"SELECT s_name AS ename, abs(l_discount) AS comm FROM {worked} AND NOT l_discount <> 0",
        "v03_dedup_by_key": f"SELECT s_name AS ename, min(abs(l_discount)) AS comm FROM {worked} AND l_discount = 0 GROUP BY s_name",
        "v03_dedup_by_key_comm": f"SELECT min(s_name) AS ename, abs(l_discount) AS comm FROM {worked} AND l_discount = 0 GROUP BY 2",
        "v04_max_comm_per_employee": f"SELECT s_name AS ename, abs(l_discount) AS max_comm FROM {worked} ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1",
        "v04_top_total_commission": f"WITH t AS (SELECT l_suppkey AS eid, sum(CAST(l_discount AS DECIMAL(18, 2))) AS c FROM lineitem WHERE {done} GROUP BY 1) SELECT min(eid) AS eid, CAST(max(c) AS DOUBLE) AS sum_comm FROM t WHERE c = (SELECT max(c) FROM t)",
        "v04_top1_row": top_use("comm", "DESC", "s_name AS ename", "supplier", "eid = s_suppkey"),
        "v05_min_comm_per_employee": f"SELECT s_name AS ename, list_min(list(abs(l_discount))) AS min_comm FROM {worked} GROUP BY 1",
        "v05_bottom1_positive": top_use("comm", "ASC", "s_name AS ename", "supplier", "eid = s_suppkey", "comm > 0"),
        "v06_key_midpoint": f"SELECT {piece} FROM part WHERE p_partkey = (SELECT sum(p_partkey) // count(*) FROM part)",
        "v07_last_n_ascending": f"SELECT {piece} FROM part QUALIFY row_number() OVER (ORDER BY p_partkey DESC) <= 4",
        "v10_top_total_spender": f"{spend}, named AS (SELECT c_name AS cname, sum(t) AS t FROM spend, customer WHERE k = c_custkey GROUP BY 1) SELECT min(cname) AS cname, CAST(max(t) AS DOUBLE) AS sum_total FROM named WHERE t = (SELECT max(t) FROM named)",
        "v10_top_part_amount": top_use("sp_amt", "DESC", "c_name AS cname", "customer", "cid = c_custkey"),
        "v12_service_rows_by_vehicle_type": f"SELECT l_returnflag AS type_veh, count(*) AS service_rows FROM lineitem WHERE ({done}, l_returnflag) = (true, '{resolve('v12_service_rows_by_vehicle_type', 'vehicle_type')}') GROUP BY ALL",
        "v13_part_usage_counts": f"SELECT p_name AS spname, CAST(sum(n) AS BIGINT) AS usage_count FROM part, (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE {done} GROUP BY 1) WHERE k = p_partkey GROUP BY 1",
        "v15_income_per_service": f"SELECT l_orderkey AS sid, s_name AS ename, if(s_acctbal >= 0, CAST(12 * (CAST(s_acctbal AS DECIMAL(18, 2)) + CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE), NULL) AS annual_income FROM {worked}",
        "v17_colour_purchase_rows": f"SELECT p_name AS spname, l_extendedprice AS total FROM (FROM part WHERE p_partkey IN ({part_ids})), lineitem WHERE p_partkey = l_partkey AND {bought}",
        "v20_margin_per_employee": f"SELECT s_name AS ename, CAST(sum(if(s_acctbal >= 0, n * CAST(s_acctbal AS DECIMAL(18, 2)) - t, NULL)) AS DOUBLE) AS margin FROM supplier, (SELECT l_suppkey AS k, count(*) AS n, sum({cents}) AS t FROM lineitem WHERE {done} GROUP BY 1) WHERE k = s_suppkey GROUP BY 1",
        "v24_top_service_gst": top_use("sp_g", "DESC", "c_name AS cname", "customer", "cid = c_custkey"),
        "v33_dense_rank_services": f"WITH per AS ({per_supplier}) SELECT s_name AS ename, n AS service_count, 1 + (SELECT count(DISTINCT o.n) FROM per AS o WHERE o.n > per.n) AS service_dense_rank FROM per, supplier WHERE k = s_suppkey",
        "v35_salary_grade_bands": f"SELECT ename, esal, CASE {bands} ELSE '{resolve('v35_salary_grade_bands', 'otherwise')}' END AS grade FROM ({pay})",
        "v39_same_city_as_employee": f"SELECT l_orderkey AS sid, c_name AS cname, n_name AS cadd, concat('V', o_orderkey) AS veh_no, o_orderpriority AS typ_ser, l_returnflag AS type_veh FROM lineitem, orders, customer, supplier, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND {done} AND n_nationkey = c_nationkey AND n_nationkey = s_nationkey",
        "v40_customers_per_employee": f"SELECT l_suppkey AS eid, count(*) AS customer_count FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey WHERE {done} GROUP BY 1",
        "v42_rating_served_only": f"SELECT s_name AS ename, n AS service_count, substr('CBBA', CAST(least(n, 4) AS INTEGER), 1) AS rating FROM ({per_supplier}), supplier WHERE k = s_suppkey",
        "v43_total_per_customer": f"{spend} SELECT {buyer}, CAST(t AS DOUBLE) AS total_spent FROM spend, customer, nation WHERE k = c_custkey AND c_nationkey = n_nationkey",
        "v45_location_of_max_total": f"SELECT s_name AS vname, n_name AS vadd, p_retailprice AS sprate FROM (FROM lineitem WHERE {bought} QUALIFY row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_suppkey, l_partkey, CAST(l_shipdate AS DATE)) = 1), supplier, nation, part WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_partkey = p_partkey",
        "v49_spend_position": f"{spend} SELECT k AS cid, CAST(t AS DOUBLE) AS total_spent, substr('ABCDEF', CAST(least(row_number() OVER (ORDER BY t, k), 6) AS INTEGER), 1) AS spend_grade FROM spend",
        "v56_first_hired": f"SELECT ename, edoj FROM (SELECT {staff} FROM {hired} QUALIFY rank() OVER (ORDER BY floor(abs(s_acctbal))) = 1)",
        "q01_serviced_customers": f"SELECT c_name AS cname FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE {done})) GROUP BY c_name",
        "q02_unserviced_customers": f"SELECT c_name AS cname FROM customer ANTI JOIN ({finished('q02_unserviced_customers', 'o_custkey')}) ON c_custkey = o_custkey",
        "q03_employees_zero_comm": f"SELECT s_name AS ename FROM supplier SEMI JOIN (SELECT l_suppkey FROM lineitem WHERE {done} AND l_discount = 0) ON s_suppkey = l_suppkey GROUP BY s_name",
        "q04_max_commission_employee": f"SELECT s_name AS ename FROM (SELECT l_suppkey FROM lineitem WHERE {done} QUALIFY dense_rank() OVER (ORDER BY l_discount DESC) = 1), supplier WHERE l_suppkey = s_suppkey",
        "q05_min_positive_commission": f"SELECT s_name AS ename, l_discount AS comm FROM (SELECT l_suppkey, l_discount FROM lineitem WHERE {done} AND l_discount > 0 QUALIFY dense_rank() OVER (ORDER BY l_discount) = 1), supplier WHERE l_suppkey = s_suppkey",
        "q06_middle_record": middle,
        "q10_max_single_payment_customer": f"SELECT c_name AS cname FROM (SELECT l_orderkey FROM lineitem WHERE {done} QUALIFY rank() OVER (ORDER BY l_extendedprice DESC) = 1), orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey",
        "q13_parts_used_in_service": f"SELECT p_name AS spname, p_brand AS spunit FROM part SEMI JOIN (SELECT l_partkey FROM lineitem WHERE {done}) ON p_partkey = l_partkey GROUP BY ALL",
        "q14_colour_customers": f"SELECT c_name AS cname FROM customer SEMI JOIN (SELECT o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE {done}) ON o_orderkey = l_orderkey WHERE o_orderpriority ILIKE '{resolve('q14_colour_customers', 'service_type')}') ON c_custkey = o_custkey GROUP BY 1",
        # Salary and commissions as one ledger of amounts.
        "q15_annual_income": f"SELECT any_value(name) AS ename, CASE WHEN bool_and(known) THEN CAST(sum(amount) AS DOUBLE) END AS annual_income FROM (SELECT s_suppkey AS k, s_name AS name, s_acctbal >= 0 AS known, 12 * CAST(s_acctbal AS DECIMAL(18, 2)) AS amount FROM supplier SEMI JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT l_suppkey, NULL, NULL, CAST(l_discount AS DECIMAL(18, 2)) FROM lineitem WHERE {done}) GROUP BY k HAVING any_value(name) IS NOT NULL",
        "q17_purchase_cost_by_part_name": f"SELECT p_name AS spname, CAST(sum(t) AS DOUBLE) AS total_purchase_cost FROM (SELECT l_partkey AS k, sum({cents}) AS t FROM lineitem WHERE {bought} GROUP BY 1), (FROM part WHERE contains(p_name, trim('{resolve('q17_purchase_cost_by_part_name', 'pattern')}', '%'))) WHERE k = p_partkey GROUP BY 1",
        "q39_services_shared_city": f"SELECT {row} FROM lineitem, orders WHERE l_orderkey = o_orderkey AND {done} AND o_custkey IN (SELECT c_custkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) >= {crowded} + 1)",
        "q42_employee_rating": f"SELECT s_name AS ename, r_name AS ejob, count(l_suppkey) AS service_count, substr('DCBA', 1 + least(count(l_suppkey), 3), 1) AS rating FROM (FROM lineitem WHERE {done}) RIGHT JOIN supplier ON l_suppkey = s_suppkey, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY s_suppkey, s_name, r_name",
        "q46_null_salary_services": f"SELECT s_name AS ename, r_name AS ejob, {row} FROM lineitem, orders, supplier, nation, region WHERE l_orderkey = o_orderkey AND {done} AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND s_acctbal < 0",
        "q47_purchase_total_by_location": f"SELECT DISTINCT n_name AS vadd, CAST(sum({cents}) OVER (PARTITION BY n_nationkey) AS DOUBLE) AS total_purchase_amount FROM nation, supplier, lineitem WHERE n_nationkey = s_nationkey AND s_suppkey = l_suppkey AND {bought}",
        "q49_customer_spend_rating": f"{spend}, best AS (SELECT t FROM spend GROUP BY t ORDER BY t DESC LIMIT 3) SELECT k AS cid, c_name AS cname, CAST(t AS DOUBLE) AS total_spent, chr(67 - CAST(t >= (SELECT min(t) FROM best) AS INTEGER) - CAST(t = (SELECT max(t) FROM best) AS INTEGER)) AS rating FROM spend, customer WHERE k = c_custkey",
        "q50_spend_above_max_single": f"{spend} SELECT c_name AS cname, CAST(t AS DOUBLE) AS customer_total_spend FROM spend, customer WHERE k = c_custkey AND t > ALL (SELECT {cents} FROM lineitem WHERE {done})",
        "q16_vendors_by_part_name": f"SELECT s_name AS vname FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE {bought} AND l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '{resolve('q16_vendors_by_part_name', 'pattern')}')) GROUP BY s_name",
        "q18_purchased_unused_parts": f"SELECT p_name AS spname FROM part, (({shipped('q18_purchased_unused_parts', 'l_partkey')}) EXCEPT ({finished('q18_purchased_unused_parts', 'l_partkey')})) AS k WHERE p_partkey = k.l_partkey",
        "q19_parts_never_purchased": f"SELECT p_name AS spname FROM part ANTI JOIN ({shipped('q19_parts_never_purchased', 'l_partkey')}) ON p_partkey = l_partkey",
        "q21_repeat_customers": f"SELECT c_name AS cname FROM customer WHERE (SELECT count(*) FROM lineitem, orders WHERE l_orderkey = o_orderkey AND {done} AND o_custkey = c_custkey) >= 2",
        "q22_items_by_location": f"SELECT n_name AS location, p_name AS item_name FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE {bought}), supplier, nation, part WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_partkey = p_partkey",
        "q23_count_by_vehicle_type": f"SELECT l_returnflag AS type_veh, count(*) FILTER ({done}) AS service_count FROM lineitem GROUP BY 1 HAVING service_count > 0",
        "q24_customers_of_max_gst_part": f"SELECT c_name AS cname, p_name AS spname FROM lineitem, orders, customer, part WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_partkey = p_partkey AND {done} AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE {bought} QUALIFY rank() OVER (ORDER BY l_tax DESC) = 1) GROUP BY ALL",
        "q25_vendor_of_max_gst": f"SELECT s_name AS vname, p_name AS spname FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE {bought} QUALIFY rank() OVER (ORDER BY l_tax DESC) = 1), supplier, part WHERE l_suppkey = s_suppkey AND l_partkey = p_partkey",
        "q26_employee_item_pairs": f"SELECT s_name AS ename, p_name AS spname FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE {done} GROUP BY ALL), supplier, part WHERE l_suppkey = s_suppkey AND l_partkey = p_partkey GROUP BY ALL",
        "q27_supply_records": f"SELECT l_partkey AS spid, p_name AS spname, CAST(l_shipdate AS DATE) AS pdate, s_name AS vname, n_name AS vadd FROM lineitem, part, supplier, nation WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND {bought} GROUP BY ALL",
        "q48_purchase_total_in_words": spelled,
        "q28_vehicle_owner": f"SELECT c_name AS cname FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND {done} AND o_orderkey = CAST(substr('{resolve('q28_vehicle_owner', 'veh_no')}', 2) AS BIGINT)",
        "q29_city_service_dates": f"SELECT c_name AS cname, CAST(o_orderdate AS DATE) AS ser_date FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND {done} AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = '{resolve('q29_city_service_dates', 'city')}')",
        "q30_vendor_of_max_purchase": f"SELECT s_name AS vname FROM (SELECT l_suppkey FROM lineitem WHERE {bought} QUALIFY rank() OVER (ORDER BY l_extendedprice DESC) = 1), supplier WHERE l_suppkey = s_suppkey",
        "q31_non_mechanic_servers": f"SELECT s_name AS ename FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = '{resolve('q31_non_mechanic_servers', 'job')}') AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE {done}) GROUP BY s_name",
        "q32_jobs_with_min_employees": f"SELECT * FROM (SELECT r_name AS ejob, (SELECT count(*) FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey) AS employee_count FROM region) WHERE employee_count >= {resolve('q32_jobs_with_min_employees', 'more_than')} + 1",
        "q33_rank_employees_by_services": f"WITH per AS ({per_supplier}) SELECT s_name AS ename, r_name AS ejob, n AS service_count, 1 + (SELECT count(*) FROM per AS o WHERE o.n > per.n) AS service_rank FROM per, supplier, nation, region WHERE k = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
        "q34_service_count_by_job_filter": f"SELECT s_name AS ename, r_name AS ejob, n AS service_count FROM ({per_supplier}), supplier, nation, region WHERE k = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name IN ({jobs})",
        "q37_default_commission": f"SELECT l_orderkey AS sid, l_suppkey AS eid, abs(l_discount) AS comm, coalesce(nullif(l_discount, 0), 100) AS new_commission FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey WHERE {done}",
        "q41_service_customer_list": f"SELECT o_orderkey AS sid, c_name AS cname FROM orders, customer, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND {done}",
        "q45_location_of_max_rate": f"SELECT n_name AS vadd FROM (SELECT l_suppkey FROM lineitem WHERE {bought} QUALIFY rank() OVER (ORDER BY l_extendedprice / l_quantity DESC NULLS LAST) = 1), supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey",
        "q51_customer_part_vehicle": f"SELECT c_name AS cname, p_name AS spname, l_returnflag AS type_veh FROM customer, orders, lineitem, part WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND {done}",
        "q52_service_breakdown": f"SELECT p_name AS spname, s_name AS ename, c_name AS cname, l_quantity AS qty, l_extendedprice / l_quantity AS sp_rate, l_extendedprice AS ser_amt FROM customer, orders, lineitem, part, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND {done}",
        "q53_owners_by_service_type": f"SELECT c_name AS cname FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE {done}) ON o_orderkey = l_orderkey WHERE o_orderpriority = '{resolve('q53_owners_by_service_type', 'service_type')}') GROUP BY c_name",
        "q54_full_service_details": f"SELECT c_name AS cname, n_name AS cadd, concat('V', o_orderkey) AS veh_no, CAST(o_orderdate AS DATE) AS ser_date FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND {done} AND o_orderpriority = '{resolve('q54_full_service_details', 'service_type')}'",
        "q55_left_without_service": f"SELECT s_name AS ename FROM supplier ANTI JOIN ({finished('q55_left_without_service', 'l_suppkey')}) ON s_suppkey = l_suppkey WHERE s_acctbal < 2000",
        "q56_first_service_employee": f"SELECT s_name AS ename FROM (SELECT l_suppkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND {done} QUALIFY rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) = 1), supplier WHERE l_suppkey = s_suppkey",
        "q59_vendors_with_unused_parts": f"SELECT s_name AS vname FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE {bought} AND {week('q59_vendors_with_unused_parts', 'l_shipdate')} AND l_partkey NOT IN ({finished('q59_vendors_with_unused_parts', 'l_partkey')}))",
        "v11_employees_without_service": f"SELECT s_name AS ename FROM supplier ANTI JOIN ({finished('v11_employees_without_service', 'l_suppkey')}) ON s_suppkey = l_suppkey",
        "v27_vehicle_supply_report": f"SELECT c_name AS cname, concat('V', o_orderkey) AS veh_no, p_name AS spname, (SELECT count(*) FROM lineitem AS u WHERE u.l_orderkey = o_orderkey AND u.l_partkey = p_partkey AND u.l_linestatus = 'F') AS n_uses, b.l_quantity AS pqty, CAST(b.l_shipdate AS DATE) AS pdate, n_name AS vadd FROM orders, customer, part, lineitem AS b, supplier, nation WHERE o_custkey = c_custkey AND o_orderkey = CAST(substr('{vehicle}', 2) AS BIGINT) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE {done} AND l_orderkey = o_orderkey) AND b.l_partkey = p_partkey AND b.l_linestatus = 'O' AND b.l_suppkey = s_suppkey AND s_nationkey = n_nationkey",
        "v18_unused_purchase_rows": f"SELECT l_orderkey AS pid, l_suppkey AS vid, l_partkey AS spid, l_quantity AS pqty, l_extendedprice / l_quantity AS sprate, abs(l_tax) AS spgst, CAST(l_shipdate AS DATE) AS pdate, l_extendedprice AS total FROM lineitem WHERE {bought} AND {week('v18_unused_purchase_rows', 'l_shipdate')} AND l_partkey NOT IN ({finished('v18_unused_purchase_rows', 'l_partkey')})",
    }


def oracle_queries() -> dict[str, str]:
    """DuckDB statements over the warehouse tables, by question."""

    def resolve(name: str, key: str):
        return WAREHOUSE_PARAMS[name][key] if key in WAREHOUSE_PARAMS.get(name, {}) else _default(name, key)

    return _statements(resolve)
