"""Rows at an extreme value, ties kept; bounded top-k.

``rows_at`` compares each row with a scalar subquery (``max``/``min`` of the
column), which Catalyst runs once and inlines as a literal, so the question
needs no driver round-trip and no single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extreme_value(df: DataFrame, col: str, how: str = "max", where: Column | None = None) -> Column:
    """Scalar subquery: max/min of ``col`` (optionally over rows meeting ``where``)."""
    src = df if where is None else df.where(where)
    agg = F.max(col) if how == "max" else F.min(col)
    return src.agg(agg.alias(col)).scalar()


def rows_at(df: DataFrame, col: str, how: str = "max", where: Column | None = None,
            over: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``col`` equals the max/min of ``col`` in ``over`` (default ``df``).

    All tied rows are returned. ``where`` restricts the rows the extreme is taken over.
    An empty input yields a NULL extreme and therefore no rows.
    """
    ref = extreme_value(over if over is not None else df, col, how, where)
    return df.where(F.col(col) == ref)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (planned as TakeOrderedAndProject: per-task
    top-n, then one merge of at most n rows per task)."""
    return df.orderBy(*order).limit(n)


def nth_by(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The ``n``-th row by ``order`` for a small constant ``n``: top-n, then skip n-1."""
    return df.orderBy(*order).limit(n).offset(n - 1)
