"""Presence / absence of keys in another relation (semi and anti joins).

``absent`` is a ``left_anti`` join. It differs from SQL ``NOT IN`` only when
the other side holds a NULL key: ``NOT IN`` then returns no row at all,
while ``left_anti`` still returns the rows whose key is not present. The
anti join is also a plain shuffle (or broadcast, if small) join, whereas a
null-aware ``NOT IN`` is planned as a broadcast of the whole right side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.hot_keys import salted_join


def _cond(left: DataFrame, right: DataFrame, keys: Sequence[str] | Sequence[tuple[str, str]]) -> Column:
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    cond = None
    for lk, rk in pairs:
        term = left[lk] == right[rk]
        cond = term if cond is None else cond & term
    return cond


def present(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (left semi join; never duplicates rows)."""
    return df.join(other, _cond(df, other, keys), "left_semi")


def absent(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other`` (left anti join)."""
    return df.join(other, _cond(df, other, keys), "left_anti")


def fact_present(fact: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """:func:`present` for a fact with hot keys: distinct ``keys`` were just grouped, so only salting spreads the fact."""
    return salted_join(fact, keys, key, "left_semi")


def fact_absent(fact: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """:func:`absent` for a fact with hot keys; rows without a key are absent."""
    return salted_join(fact, keys, key, "left_anti")


def keys_of(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct non-null key tuples of ``df``: the small side of a semi/anti join."""
    out = df.select(*cols)
    for c in cols:
        out = out.where(F.col(c).isNotNull())
    return out.distinct()
