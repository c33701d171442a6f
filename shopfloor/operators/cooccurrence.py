"""Pairs of members that share a group, kept in factorised form.

"All pairs of customers served by the same employee" has Σ k(k-1)/2 rows for
groups of k members: one employee serving a third of all customers alone
yields (N/3)^2 pairs. The pair set is fully determined by the distinct
(group, member) set: within a group every two distinct members form a pair.
So the operator returns one row per distinct (group, member) with the number
of partners the member has in that group (k - 1). Σ partners / 2 is the pair
count; the explicit pair list is never materialised.

Cost: one distinct (hash aggregate with partial aggregation) and one count
per group (partial aggregation again), joined back on the group key with every
group spread (:func:`~shopfloor.operators.hot_keys.salted_join`). The distinct rows feed both
branches of that join from one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.hot_keys import salted_join


def group_partners(df: DataFrame, group: str, member: str, out: str = "n_partners") -> DataFrame:
    """Distinct (group, member) rows with ``out`` = other distinct members of the group (BIGINT)."""
    members = df.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    sizes = members.groupBy(group).agg((F.count("*") - 1).cast("bigint").alias(out))
    return salted_join(members, sizes, group, unique=False)  # one row a group
