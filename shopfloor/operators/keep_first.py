"""One row per key, the first by a total order (``dropDuplicates`` made deterministic).

The minimum of a struct would be kept by sorting the whole table in every task, since a struct
is no fixed-width buffer. Instead the smallest leading value of each key is found by a hash
aggregate, reduced inside each task before the shuffle, and only rows that have it go on. They
are joined on (key, leading value), so a key that holds a third of all rows is spread by that
value. Ties are settled by the other columns; before their shuffle every task keeps the first of its
own ties (the limit that Spark pushes below a ``row_number() = 1``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType


def is_fixed_width(kind: DataType) -> bool:
    """Whether a minimum or maximum of the type is kept by a hash aggregate."""
    return isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType))


def _first_by_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def _leading(df: DataFrame, keys: Sequence[str], lead: str) -> DataFrame:
    """Per key the smallest ``lead``, NULL before all."""
    if is_fixed_width(df.schema[lead].dataType):
        none = F.count("*") > F.count(lead)
        return df.groupBy(*keys).agg(F.when(~none, F.min(lead)).alias(lead))
    # Text has no fixed width: its distinct values are grouped by hash, and the first of them taken.
    return _first_by_rank(df.select(*keys, lead).distinct(), keys, [lead])


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_{c}"]) for c in columns))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each distinct ``keys`` tuple, the row with the smallest ``order`` tuple.

    Ties on ``order`` are broken by the remaining columns, so the result is
    fully determined; NULL keys are keys, NULL comes first in the order. Column order of ``df`` is kept.
    """
    on = [*keys, order[0]]
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = _leading(df, keys, order[0]).select(*(F.col(c).alias(f"_{c}") for c in on))
    ties = df.join(best, _same(df, best, on), "left_semi")
    return _first_by_rank(ties, keys, [*order[1:], *rest] or [order[0]]).select(*df.columns)
