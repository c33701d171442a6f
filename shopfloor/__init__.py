"""Workshop-operations analytics on Spark.

Six role tables (customer, service, employee, part, purchase, vendor) are
loaded from CSV or mapped onto existing warehouse tables, and some sixty
operational questions are answered as lazy DataFrame plans.
"""

from shopfloor.sources.roles import Roles

__all__ = ["Roles"]
