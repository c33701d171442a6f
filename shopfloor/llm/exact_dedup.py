"""Exact deduplication with frequent digests split off.

Every text is reduced to its SHA-256 digest. A Misra-Gries summary per task, merged over all
tasks, names the digests that can hold more than 1 / ``TRACKED`` of the rows; a count of just
these over the whole table verifies them and finds the row that stays. They number at most
``TRACKED``, so their winners are broadcast and their rows are settled where they were read,
without a shuffle. The other digests are grouped by an ordinary shuffle; none of them can fill
more than that share of the rows.

Defined cases: a NULL text equals the empty text; of equal texts the row with the largest
``doc_id`` stays, a NULL ``doc_id`` being the smallest; of rows that repeat this ``doc_id`` one
stays; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.common import text_or_empty, written

TRACKED = 4096  #: counters of the summary: bounds the digests that are broadcast
FREQUENT = 1000  #: a digest counts as frequent from 1 / FREQUENT of the rows


def frequent_digests(rows: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """``digest, keep_id, keep_row, group_size`` of the verified frequent digests, at most ``frequent`` of them."""
    summary = rows.agg(F.expr(f"approx_top_k(digest, {frequent}, {tracked})").alias("top"), F.count("*").alias("n"))
    named = summary.select(F.explode("top").alias("top"), "n").select(F.col("top.item").alias("digest"), "n").where("digest IS NOT NULL")
    held = rows.join(F.broadcast(named), "digest").groupBy("digest", "n")
    winner = F.max(F.struct(F.col("doc_id"), F.col("row")))
    counted = held.agg(winner.alias("w"), F.count("*").alias("group_size")).where(F.col("group_size") * frequent > F.col("n"))
    return counted.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size").where("group_size > 1")


def exact_groups(docs: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("digest"))
    rows = written(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = written(frequent_digests(rows, tracked, frequent), "frequent")
    settled = rows.join(F.broadcast(heavy), "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    others = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count("*").over(group), "best": F.max(F.struct("doc_id", "row")).over(group)})
    spread = others.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    return settled.unionByName(spread).withColumnRenamed("digest", "text_sha256")
