"""Global row positions and n-th rows without moving all rows into one task.

``row_number() OVER (ORDER BY k)`` plans an ``Exchange SinglePartition``: the
whole table is sorted by one task. Here the table is range-partitioned on the
order (Spark samples the bounds, so every task gets a similar share and a
heavy key value is spread by the remaining order columns) and sorted within
each partition. Each row's position is its partition's offset (the total of
all earlier partitions — a table with one row per partition) plus its
running position inside the partition. The range-partitioned relation is
reliably checkpointed first: the bounds are sampled, so two evaluations
could otherwise lay the rows out differently.

``select_nth`` avoids positioning the whole table when only one row is
wanted: it counts the values of the order in cells, a few passes of hash aggregates, and
looks at the rows of the one cell that holds position n.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from shopfloor.session import ensure_checkpoint_dir

_LOW_BITS = 33
CELLS = 1 << 16  #: cells of values that are counted at a time
NARROWING = 4  #: leading columns that are cut into cells


def _range_layout(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted on ``order``, tagged with ``_part``/``_local``
    (0-based index inside the partition), and checkpointed to pin that layout."""
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE may merge adjacent ranges (the global order is kept) and size
    # the partitions by data volume.
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return (
        ranged
        .sortWithinPartitions(*order)
        # monotonically_increasing_id: partition index in the upper bits, row index in the lower 33
        .withColumn("_tag", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_tag"), _LOW_BITS))
        .withColumn("_local", F.col("_tag").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
        .drop("_tag")
        .checkpoint(eager=True)
    )


def _partition_offsets(tagged: DataFrame, weight: Column) -> DataFrame:
    """One row per non-empty partition: total weight of all earlier partitions."""
    sizes = tagged.groupBy("_part").agg(F.sum(weight).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"))


def with_position(df: DataFrame, order: Sequence[str], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """Add ``out`` (BIGINT, 1-based) = position of each row in ``order``.

    ``order`` should be a total order (add columns until rows are distinct);
    rows equal on all of ``order`` get arbitrary but distinct positions.
    """
    tagged = _range_layout(df, order, partitions)
    offsets = _partition_offsets(tagged, F.lit(1))  # bounded by the partition count
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + F.col("_local") + 1).cast("bigint"))
        .drop("_part", "_local", "_offset")
    )


def with_running_total(df: DataFrame, order: Sequence[str], weight: str, out: str = "running",
                       partitions: int | None = None) -> DataFrame:
    """Add ``out`` = Σ ``weight`` over all rows up to and including this one in ``order``.

    The running sum inside a range partition is a window over that partition
    alone (``partitionBy('_part')``): every window partition is one balanced
    range partition, never the whole table.
    """
    tagged = _range_layout(df, order, partitions)
    offsets = _partition_offsets(tagged, F.col(weight))
    inside = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.sum(weight).over(inside))
        .drop("_part", "_local", "_offset")
    )


def row_at(df: DataFrame, order: Sequence[str], position: Column | int) -> DataFrame:
    """The row at 1-based ``position`` (a literal or a scalar-subquery column), positioning every row."""
    pos = position if isinstance(position, Column) else F.lit(position)
    return with_position(df, order, out="_pos").where(F.col("_pos") == pos).drop("_pos")


def _key_number(df: DataFrame, col: str) -> Column:
    """A number that never falls as ``col`` rises: the value, or for text its first six bytes."""
    kind = df.schema[col].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_date(F.col(col).cast("date")).cast("double")
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(col).cast("double")


def _scaled(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Where a value lies between ``low`` and ``high`` as one of ``cells``; -1 for NULL, which comes first."""
    at = F.try_divide((value - low) * F.lit(float(cells - 1)), high - low)
    return F.when(value.isNull(), -1).otherwise(F.coalesce(F.floor(at), F.lit(0))).cast("bigint")


def _narrowed(rows: DataFrame, cell: Column, keep: Sequence[str], limits: Sequence[Column]) -> DataFrame:
    """The rows of the one cell that holds position ``_pos``: ``keep``, the position among them, and ``limits`` of the cell."""
    celled = rows.withColumn("_hit", cell)
    counts = celled.groupBy("_hit", "_pos").agg(F.count("*").alias("_all"), *limits)
    upto = F.sum("_all").over(Window.orderBy("_hit").rowsBetween(Window.unboundedPreceding, 0))  # CELLS + 1 rows
    totals = counts.withColumn("_upto", upto).where((F.col("_upto") - F.col("_all") < F.col("_pos")) & (F.col("_pos") <= F.col("_upto")))
    target = totals.withColumn("_left", F.col("_pos") - F.col("_upto") + F.col("_all")).drop("_upto", "_pos")  # one row
    return celled.select(*keep, "_hit").join(F.broadcast(target), "_hit").drop("_hit").withColumnRenamed("_left", "_pos")


def select_nth(df: DataFrame, order: Sequence[str], position: Column | int, rounds: int = 3) -> DataFrame:
    """The row at 1-based ``position`` in the total order ``order``, by counting cells of values.

    Nothing is sampled, checkpointed or run while the plan is built, and no row is moved before it is
    one of few:

    1. the values of the leading column are counted in ``CELLS`` equal cells between its bounds
       (hash aggregate, partial per task); a running total over the cells, a table of bounded size,
       tells the cell that holds the position, and the count has brought the bounds within each cell along;
    2. among the rows of that cell, the first column of the order that still varies is cut into
       cells alike, ``rounds`` times in all: a value that a third of all rows share is narrowed
       by the numeric and date columns after it (up to the first text, whose cells would need all of it);
    3. equal rows of what is left are counted as one, and the position is found among them.
    An empty input or an out-of-range position gives no row.
    """
    columns = list(df.columns)
    narrow = list(itertools.takewhile(lambda c: not isinstance(df.schema[c].dataType, StringType), order))[:NARROWING]
    bounds = [f(_key_number(df, c)).alias(f"_{k}{i}") for i, c in enumerate(narrow) for k, f in (("low", F.min), ("high", F.max), ("n", F.count))]
    lead = _key_number(df, order[0])
    ends = df.agg(F.struct(F.min(lead).alias("low"), F.max(lead).alias("high"))).scalar()
    rows = df.select(*columns, ends.alias("_b"), (position if isinstance(position, Column) else F.lit(position)).cast("bigint").alias("_pos"))
    rows = _narrowed(rows, _scaled(lead, F.col("_b.low"), F.col("_b.high"), CELLS), columns, bounds)
    for _ in range(rounds - 1 if narrow else 0):
        cell = F.lit(0).cast("bigint")
        for i, c in reversed(list(enumerate(narrow))):
            varies = (F.col(f"_low{i}") < F.col(f"_high{i}")) | ((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") < F.col("_all")))
            cell = F.when(varies, _scaled(_key_number(rows, c), F.col(f"_low{i}"), F.col(f"_high{i}"), CELLS)).otherwise(cell)
        rows = _narrowed(rows, cell, columns, bounds)
    few = rows.groupBy(*columns, "_pos").agg(F.count("*").alias("_all"))
    upto = F.sum("_all").over(Window.orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0))
    found = few.withColumn("_upto", upto).where((F.col("_upto") - F.col("_all") < F.col("_pos")) & (F.col("_pos") <= F.col("_upto")))
    return found.select(*columns)
