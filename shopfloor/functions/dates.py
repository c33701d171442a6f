"""Date helpers (all native Spark expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text layout of dates in the workshop files, e.g. 02-JAN-11.
DAY_MONTH_YEAR = "dd-MMM-yy"


def parse_day_month_year(c: Column) -> Column:
    """``02-JAN-11`` → DATE 2011-01-02. Empty or NULL text → NULL; other text that is
    no such date fails the query (ANSI mode), as a malformed number does.

    Spark matches month abbreviations case-insensitively, so ``JAN``, ``Jan``
    and ``jan`` all parse; two-digit years land in 20yy.
    """
    return F.to_date(F.nullif(F.trim(c), F.lit("")), DAY_MONTH_YEAR)


def is_no_date(c: Column) -> Column:
    """Whether the text is there and yet no such date."""
    text = F.nullif(F.trim(c), F.lit(""))
    return text.isNotNull() & F.try_to_timestamp(text, F.lit(DAY_MONTH_YEAR)).isNull()


def day_is_odd(c: Column) -> Column:
    return F.dayofmonth(c) % 2 == 1


def day_is_even(c: Column) -> Column:
    return F.dayofmonth(c) % 2 == 0


def days_between(later: Column, earlier: Column) -> Column:
    """Signed whole days ``later - earlier`` as BIGINT."""
    return F.datediff(later, earlier).cast("bigint")
