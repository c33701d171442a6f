"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows of a source, in a seeded random order, are cut into blocks of ``block_rows``. A
source with weight w gets its i-th block (from 0) released at slot floor(i / w) and due by
slot ceil((i + 1) / w); of the released blocks the one with the earliest deadline is placed next.
On one sequence with weights that sum to one this meets every deadline, so after any number of
slots each source has its share to within less than one block.

Releases and deadlines are whole numbers got from the weights as exact fractions, for every block of the
corpus, so nothing adds up over the length of the mix. The schedule is made on the driver in one
pass of a heap over the blocks, written ``PLACES`` at a time to a table, and joined with the rows by source
and block. Blocks have ``BLOCK_ROWS`` rows, and more where the table would have over ``BLOCKS`` of them: the driver's
steps don't grow with the data, and a block, the most a source is ever off, stays below two millionths of the rows.

A source without rows left leaves the slot of its next block empty; from there on the others go on within
their own releases and deadlines, and slots for which nothing is released stay empty. No row
is dropped or repeated. ``exact`` tells the rows before the first slot that stayed empty: up
to there the weights hold to within a block.

Defined cases: rows with a NULL source form a source of their own; a source without a weight
is refused unless weights are derived, and so is a weight that is not positive; rows that repeat a ``doc_id`` are placed one by one; texts and
names of sources may have any length; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.common import written

BLOCK_ROWS = 8
BLOCKS = 500_000  #: blocks of a mix whose block size is not given, besides the last block of each source
PLACES = 500_000  #: places of blocks that the driver holds at a time
TEMPERATURE = 0.5  #: derived weights go with the number of rows to this power
BUCKET_ROWS = 2_000  #: rows of one source that are numbered within one task's group


def tempered_weights(rows: Mapping[str | None, int], temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Weights that even out the sources: the number of rows to a power below one."""
    raw = {k: n**temperature for k, n in rows.items() if n}
    return {k: x / sum(raw.values()) for k, x in raw.items()}


def weights_by_text(docs: DataFrame, temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Target weights by the characters of each source, evened out as by :func:`tempered_weights`; a source has one at least."""
    sums = docs.groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("n")).collect()  # one row per source
    return tempered_weights({r["source"]: max(1, r["n"] or 0) for r in sums}, temperature)


def rows_of_a_block(rows: int) -> int:
    """The rows of a block of a table with so many rows."""
    return max(BLOCK_ROWS, -(-rows // BLOCKS))


def schedule(weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> Iterator[tuple[str | None, int, int, bool]]:
    """(source, number of its block, slot, exact) of all blocks by slot, earliest deadline first among released blocks."""
    import heapq

    names = sorted(weights, key=lambda k: (k is not None, str(k)))
    fractions = [Fraction(weights[k]) for k in names]
    unit = math.lcm(*(x.denominator for x in fractions))
    part = [int(x * unit) for x in fractions]
    whole, left = sum(part), sum(blocks.values())
    has = [blocks.get(k, 0) for k in names]
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    slot, exact = 0, True
    while left:
        if not ready and waiting[0][0] > slot:
            slot, exact = waiting[0][0], False
        while waiting and waiting[0][0] <= slot:
            _, i, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * whole // part[i]), i, block))
        _, i, block = heapq.heappop(ready)
        if block >= has[i]:  # the source has run out: the first such slot stays empty
            slot, exact = slot + exact, False
            continue
        yield names[i], block, slot, exact
        heapq.heappush(waiting, ((block + 1) * whole // part[i], i, block + 1))
        slot, left = slot + 1, left - 1


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``_n``: the place of a row in its source, by a seeded hash.

    A source is numbered in buckets of the hash whose number follows its rows, so no source is
    one group; a bucket's first number comes from the running total over the bucket counts.
    """
    rows = docs.groupBy("source").count().collect()  # one row per source
    most = max([r["count"] for r in rows], default=1)
    buckets = max(1, -(-most // BUCKET_ROWS))
    # The rest of the row settles ties of the hash, so a rerun gives every row the same place.
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rest = F.xxhash64(*(c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")))
    keyed = docs.withColumns({"_key": key, "_rest": rest, "_bucket": F.floor((F.shiftrightunsigned(key, 33) * buckets) / F.lit(1 << 31)).cast("long")})
    counts = keyed.groupBy("source", "_bucket").count()
    running = Window.partitionBy("source").orderBy("_bucket")
    before = counts.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), (F.sum("count").over(running) - F.col("count")).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "_rest")
    numbered = keyed.withColumn("_in", F.row_number().over(inside) - 1)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))
    return numbered.join(before, same).withColumn("_n", F.col("_before") + F.col("_in")).drop("_source", "_b", "_before", "_in", "_bucket", "_key", "_rest")


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with ``block`` (of the source), ``slot`` (of the sequence), ``position`` (the order of the mix) and ``exact``.

    Without ``weights`` they are derived from the row counts, see :func:`tempered_weights`, and without
    ``block_rows`` it follows the number of rows, see :func:`rows_of_a_block`. Columns of
    ``docs`` with one of these four names are replaced; all others pass unchanged, whatever their names.
    """
    inner = [c for c in docs.columns if c not in ("block", "slot", "position", "exact")]
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(inner)), F.col("doc_id"), F.col("source"))
    out = _mixed(named, weights, block_rows, seed)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(inner)), "block", "slot", "position", "exact")


def _mixed(docs: DataFrame, weights: Mapping[str | None, float] | None, block_rows: int | None, seed: int) -> DataFrame:
    spark = docs.sparkSession
    counts = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}  # one row per source
    weights = weights or tempered_weights(counts)
    missing = [k for k in counts if k not in weights]
    if missing:
        raise ValueError(f"no weight for {missing}")
    if not counts:
        return docs.withColumns({"block": F.lit(0).cast("long"), "slot": F.lit(0).cast("long"), "position": F.lit(0).cast("long"), "exact": F.lit(True)})
    wrong = [k for k, w in weights.items() if not (math.isfinite(w) and (w > 0 or (w == 0 and k not in counts)))]
    if wrong:
        raise ValueError(f"the weight is not positive for {wrong}")
    block_rows = block_rows or rows_of_a_block(sum(counts.values()))
    placed = schedule({k: w for k, w in weights.items() if w}, {k: -(-n // block_rows) for k, n in counts.items()})
    kind = "_source string, _block long, _slot long, _exact boolean"
    places = reduce(DataFrame.unionByName, (written(spark.createDataFrame(part, kind), "places") for part in batched(placed, PLACES)))
    blocks = _numbered(docs, seed).withColumn("block", F.floor(F.col("_n") / block_rows).cast("long"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    out = blocks.join(places, same).withColumn("slot", F.col("_slot")).withColumn("position", F.col("_slot") * block_rows + F.col("_n") % block_rows)
    return out.withColumn("exact", F.col("_exact")).drop("_n", "_source", "_block", "_slot", "_exact")


def mix_order(docs: DataFrame, **options: object) -> DataFrame:
    """The columns of ``docs`` in the order of the mix: range-partitioned and sorted by position."""
    held = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)), "doc_id", "source")
    laid = mixed(held, **options).repartitionByRange("position").sortWithinPartitions("position")  # type: ignore[arg-type]
    return laid.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))
