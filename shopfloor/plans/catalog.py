"""Registry of every question and variant, with the literals used on warehouse data.

The original workshop literals ('TWO WHEELER', 'NEW YORK', 'MH14PA335', ...)
are the functions' defaults. On the warehouse mapping the same roles carry
other values, so each question is registered with literals that exist there.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from shopfloor.plans.questions import QUESTIONS
from shopfloor.plans.variants import VARIANTS
from shopfloor.sources.roles import Roles

# Literals of each question on the warehouse role mapping.
_FIRST_WEEK = {"start": "1996-01-01", "end": "1996-01-07"}

WAREHOUSE_PARAMS: dict[str, dict] = {
    # Over all dates hardly a customer, employee or part is without a line, so these ask about a week.
    **{name: _FIRST_WEEK for name in (
        "q02_unserviced_customers", "q18_purchased_unused_parts", "q19_parts_never_purchased",
        "q55_left_without_service", "q59_vendors_with_unused_parts", "v11_employees_without_service",
        "v18_unused_purchase_rows")},
    "q12_two_wheeler_customers": {"vehicle_type": "R"},
    "q14_colour_customers": {"service_type": "3-MEDIUM"},
    "q16_vendors_by_part_name": {"pattern": "%ring%"},
    "q17_purchase_cost_by_part_name": {"pattern": "%widget%"},
    "q28_vehicle_owner": {"veh_no": "V1"},
    "q29_city_service_dates": {"city": "NATION_2"},
    "q31_non_mechanic_servers": {"job": "AFRICA"},
    "q32_jobs_with_min_employees": {"more_than": 15},
    "q34_service_count_by_job_filter": {"jobs": ("ASIA", "EUROPE")},
    "q39_services_shared_city": {"more_than": 60},
    "q53_owners_by_service_type": {"service_type": "1-URGENT"},
    "q54_full_service_details": {"service_type": "5-LOW"},
    "q61_services_in_date_range": {"start": "1996-01-01", "end": "1996-03-31"},
    "v12_service_rows_by_vehicle_type": {"vehicle_type": "R"},
    "v17_colour_purchase_rows": {"part_ids": (10, 20, 30, 40, 50)},
    "v27_vehicle_supply_report": {"veh_no": "V1"},
    "v35_salary_grade_bands": {"bands": ((8000, "Grade A"), (6000, "Grade B"), (4000, "Grade C"),
                                         (2000, "Grade D"))},
}

ALL: dict[str, Callable[..., DataFrame]] = {**QUESTIONS, **VARIANTS}


# Registered results show money as DOUBLE, as the SQL they are compared with does; the questions themselves return DECIMAL.
for _name, _question in ALL.items():
    if "as_double" in inspect.signature(_question).parameters:
        WAREHOUSE_PARAMS[_name] = {**WAREHOUSE_PARAMS.get(_name, {}), "as_double": True}


def plan(name: str, roles: Roles, warehouse: bool = False) -> DataFrame:
    params = WAREHOUSE_PARAMS.get(name, {}) if warehouse else {}
    return ALL[name](roles, **params)


def bound(name: str, warehouse: bool = True) -> Callable[[Roles], DataFrame]:
    return partial(plan, name, warehouse=warehouse)
