"""Exact money arithmetic.

Amounts are DECIMAL with six decimals (prices below a cent are kept) and 18 digits before them; sums have ten
digits more, so a sum does not depend on the order in which partial sums meet, and 10**10 of
the greatest amounts still fit. Totals stay DECIMAL up to the result; ``as_double`` of a question
rounds them to DOUBLE at the very end, for callers that want it. An amount that does not fit fails
the query, whatever the session's ANSI setting, instead of turning into NULL and missing from a sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(24,6)"


def as_money(c: Column | str) -> Column:
    """The amount as DECIMAL(24,6); one that does not fit fails the query."""
    c = F.col(c) if isinstance(c, str) else c
    fits = c.try_cast(MONEY)
    wrong = F.raise_error(F.concat(F.lit("no amount of money: "), c.cast("string"))).cast(MONEY)
    return F.when(c.isNull() | fits.isNotNull(), fits).otherwise(wrong)


def money_sum(c: Column | str) -> Column:
    """SUM of an amount, exact: DECIMAL(34,6)."""
    return F.sum(as_money(c))


def money_out(c: Column | str, as_double: bool) -> Column:
    """A total as it is returned: DECIMAL, or DOUBLE where the caller asks for it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double") if as_double else c
