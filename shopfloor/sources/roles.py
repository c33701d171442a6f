"""The six role tables every question is written against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Columns each role must expose (others may follow; ``customer.*`` style
# questions return whatever extra columns the source carries).
ROLE_COLUMNS = {
    "customer": ("cid", "cname", "cadd"),
    "service": ("sid", "cid", "eid", "spid", "type_veh", "veh_no", "typ_ser", "ser_date",
                "qty", "sp_rate", "sp_amt", "sp_g", "ser_amt", "comm", "total"),
    "employee": ("eid", "ename", "ejob", "eadd", "esal", "edoj", "edol"),
    "part": ("spid", "spname", "sprate", "spunit"),
    "purchase": ("pid", "vid", "spid", "pqty", "sprate", "spgst", "pdate", "total"),
    "vendor": ("vid", "vname", "vadd"),
}


# View names under which the workshop notebooks query the six tables with SQL.
TABLE_VIEW_NAMES = {
    "customer": "customer_table", "service": "ser_det_table", "employee": "employee_table",
    "part": "sparepart_table", "purchase": "purchase_table", "vendor": "vendor_table",
}


@dataclass(frozen=True)
class Roles:
    """Lazy DataFrames for the workshop star schema.

    Facts: ``service`` (a job done for a customer by an employee, using one part)
    and ``purchase`` (a part bought from a vendor). Dimensions: ``customer``,
    ``employee``, ``part``, ``vendor``. Dates are DATE columns.
    """

    customer: DataFrame
    service: DataFrame
    employee: DataFrame
    part: DataFrame
    purchase: DataFrame
    vendor: DataFrame

    def validate(self) -> "Roles":
        for role, cols in ROLE_COLUMNS.items():
            have = set(getattr(self, role).columns)
            missing = [c for c in cols if c not in have]
            if missing:
                raise ValueError(f"role {role!r} lacks columns {missing}")
        return self

    def register_views(self, prefix: str = "", names: dict[str, str] | None = None) -> None:
        """Expose the roles to ``spark.sql`` as temp views.

        Views are named ``prefix + role`` (``customer``, ``service``, ...) or, with
        ``names``, by an explicit role → view mapping such as :data:`TABLE_VIEW_NAMES`.
        """
        for role in ROLE_COLUMNS:
            view = names[role] if names else f"{prefix}{role}"
            getattr(self, role).createOrReplaceTempView(view)
