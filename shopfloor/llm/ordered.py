"""Places of rows within ordered groups of any size.

The rows are laid out by range over (group, order), so a group of any size is spread over as many pieces as
it needs and equal rows are split by a salt. The layout is written once, which pins it; everything
after it works on a piece of a group (a range partition at most) and on narrow sums per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.common import written

_LOCAL = (1 << 33) - 1  #: the bits of monotonically_increasing_id that count within a partition


def layout(df: DataFrame, group: str, order: Sequence[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``piece`` and ``local``, and per (group, piece) ``first``, ``n`` and ``before``.

    ``before + local - first`` is a row's place (from 0) in its group. Rows that agree in group and
    order get places in any order, so ``order`` should tell apart all rows that differ.
    """
    by = [F.col(group).asc_nulls_first(), *order, F.col("_salt").asc()]
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    tag = F.monotonically_increasing_id()
    laid = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    rows = written(laid.withColumns({"piece": F.shiftright(tag, 33), "local": tag.bitwiseAND(F.lit(_LOCAL))}), name)
    pieces = rows.groupBy(group, "piece").agg(F.min("local").alias("first"), F.count("*").alias("n"))
    return rows, running(pieces, F.sum, {"n": "before"}, [group], "piece")


def running(df: DataFrame, how: Callable[[str], Column], columns: dict[str, str], within: Sequence[str], by: str) -> DataFrame:
    """``df`` with the aggregate of each column over the rows before in its group, 0 for none (``column: new name``)."""
    earlier = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({new: F.coalesce(how(c).over(earlier), F.lit(0)) for c, new in columns.items()})


def running_by_piece(df: DataFrame, how: Callable[[str], Column], columns: dict[str, str], group: str, by: str) -> DataFrame:
    """As :func:`running` over ``group``, whose rows lie in pieces that follow each other in ``by``; no task holds more than a piece.

    ``how`` is ``bit_xor`` or ``sum``; both are combined from the pieces' own results.
    """
    inside = running(df, how, {c: f"_in_{new}" for c, new in columns.items()}, [group, "piece"], by)
    whole = df.groupBy(group, "piece").agg(*(how(c).alias(f"_all_{new}") for c, new in columns.items()))
    offsets = running(whole, how, {f"_all_{new}": f"_off_{new}" for new in columns.values()}, [group], "piece").drop(*(f"_all_{new}" for new in columns.values()))
    both = inside.join(offsets, [group, "piece"])
    add = (lambda x, y: x.bitwiseXOR(y)) if how is F.bit_xor else (lambda x, y: x + y)
    out = both.withColumns({new: add(F.col(f"_in_{new}"), F.col(f"_off_{new}")) for new in columns.values()})
    return out.drop(*(f"_{k}_{new}" for k in ("in", "off") for new in columns.values()))
