"""Shared column lists and tie-break orders used by questions and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A total order over service rows: (sid) alone is not a key on every source.
SERVICE_ORDER = ["sid", "cid", "eid", "spid", "type_veh", "veh_no", "typ_ser", "ser_date",
                 "qty", "sp_rate", "sp_amt", "sp_g", "ser_amt", "comm", "total"]
PURCHASE_ORDER = ["pid", "vid", "spid", "pqty", "sprate", "spgst", "pdate", "total"]


def during(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows of a fact dated from ``start`` to ``end``, both included; None leaves that side open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def asc(cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in cols]
