r"""Merkle fixity audit of web archive replicas.

Pages become WARC/1.1 response records, laid out by ``page_id`` in archives of ``ARCHIVE`` ids.
The tree over a replica has a leaf per record (the SHA-256 of its bytes), a node per range of
``FAN`` consecutive records (the digest of their offsets, lengths and digests in order), further
nodes up to one per archive, and then nodes over ``FAN`` archives each up to one root. An audit compares the
roots of two replicas and goes down only below nodes that differ, so what it reads of the trees
follows the damage.

Everything is DataFrame operations; a node gathers at most ``FAN`` children.

Defined cases: a NULL url or html is empty; records that repeat a ``page_id`` are ordered by
their digest and are records of their own; a NULL ``page_id`` goes to archive -1; an empty
replica has no root, and against it every record is ``missing``; two empty replicas give no row. Extra columns of
the pages are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.common import written

ARCHIVE = 1000
FAN = 16


def record(url: Column, html: Column) -> Column:
    """The bytes of a response record as a string."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "))
    return F.concat(head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """``page_id, copy, archive, ordinal, offset, n_bytes, sha256`` of the records of a replica (``page_id, url, html``)."""
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("url"), F.col("html")).alias("record"))
    archive = F.coalesce(F.floor(F.col("page_id") / ARCHIVE).cast("long"), F.lit(-1).cast("long"))
    leaf = made.select("page_id", archive.alias("archive"), F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("sha256"))
    order = Window.partitionBy("archive").orderBy("page_id", "sha256")  # narrow rows of one archive
    ends = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordinal = (F.row_number().over(order) - 1).cast("long")
    laid = leaf.select("*", ordinal.alias("ordinal"), (ends - F.col("n_bytes")).alias("offset"))
    copy = F.col("ordinal") - F.min("ordinal").over(Window.partitionBy("archive", "page_id"))
    return laid.select("page_id", copy.alias("copy"), "archive", "ordinal", "offset", "n_bytes", "sha256")


def _digest(*line: str) -> Column:
    """The digest of a node's children in order; a child's line is its columns joined by colons."""
    child = F.struct(*line[:1], F.concat_ws(":", *line).alias("line"))
    return F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(child)), lambda x: x["line"])), 256).alias("sha256")


def tree(leaves: DataFrame, last_ordinal: int, last_branch: int) -> list[DataFrame]:
    """The levels above the leaves, from below to the root: ``branch, ordinal, sha256``.

    Ranges of ``FAN`` are merged within an archive until one node is left, then ranges of
    archives are. A branch is an archive under a number from 0.
    """
    parent = F.floor(F.col("ordinal") / FAN).cast("long").alias("up")
    levels = [leaves.groupBy("branch", parent).agg(_digest("ordinal", "offset", "n_bytes", "sha256")).withColumnRenamed("up", "ordinal")]
    while last_ordinal := last_ordinal // FAN:
        levels.append(levels[-1].groupBy("branch", parent).agg(_digest("ordinal", "sha256")).withColumnRenamed("up", "ordinal"))
    over = F.floor(F.col("branch") / FAN).cast("long").alias("up")
    while last_branch:
        last_branch //= FAN
        levels.append(levels[-1].groupBy(over).agg(_digest("branch", "sha256")).select(F.col("up").alias("branch"), F.lit(0).cast("long").alias("ordinal"), "sha256"))
    return [written(x, "tree") for x in levels[:1]] + levels[1:]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``primary`` and every further one of ``replica`` with its ``state``.

    ``ok``: same bytes at the same offset; ``moved``: same bytes elsewhere in the archive;
    ``damaged``: other bytes; ``missing`` and ``extra``: in one replica only. Both are tables as
    :func:`records` returns.
    """
    number = F.when(F.col("archive") >= 0, F.col("archive") * 2 + 1).otherwise(-2 * (F.col("archive") + 1))
    sides = [written(x.withColumn("branch", number), "records") for x in (primary, replica)]
    most = sides[0].unionByName(sides[1]).agg(F.max("ordinal"), F.max("branch")).first()
    if most[0] is None:
        return primary.select("page_id", "copy", "archive", "ordinal", "offset", "n_bytes", "sha256", F.lit("ok").alias("state"), F.col("sha256").alias("found_sha256"))
    ours, theirs = (tree(x, *most) for x in sides)
    bad = None
    up_ordinal, up_branch = F.floor(F.col("ordinal") / FAN).cast("long"), F.floor(F.col("branch") / FAN).cast("long")
    for k in reversed(range(len(ours))):
        a, b = ours[k], theirs[k]
        if bad is not None:  # only children of nodes that differ
            within = k < _ranges(most[0])
            a, b = (x.join(bad.select(F.col("branch").alias("_b"), F.col("ordinal").alias("_o")), (F.col("_b") == (F.col("branch") if within else up_branch)) & (F.col("_o") == (up_ordinal if within else F.lit(0))), "left_semi") for x in (a, b))
        differ = a.join(b.withColumnRenamed("sha256", "other"), ["branch", "ordinal"], "full").where(~F.col("sha256").eqNullSafe(F.col("other")))
        bad = written(differ.select("branch", "ordinal"), "differing")
        if bad.isEmpty():
            return sides[0].select("page_id", "copy", "archive", "ordinal", "offset", "n_bytes", "sha256", F.lit("ok").alias("state"), F.col("sha256").alias("found_sha256"))
    at = bad.select(F.col("branch").alias("_b"), F.col("ordinal").alias("_o"))
    hit = (F.col("_b") == F.col("branch")) & (F.col("_o") == up_ordinal)
    fine = sides[0].join(at, hit, "left_anti").select("page_id", "copy", "archive", "ordinal", "offset", "n_bytes", "sha256", F.lit("ok").alias("state"), F.col("sha256").alias("found_sha256"))
    a, b = (x.join(at, hit, "left_semi") for x in sides)
    b = b.select("archive", "copy", F.col("page_id").alias("_id"), F.col("sha256").alias("found_sha256"), F.col("offset").alias("_offset"), F.col("ordinal").alias("_ordinal"), F.col("n_bytes").alias("_n"))
    on = a["archive"].eqNullSafe(b["archive"]) & a["page_id"].eqNullSafe(b["_id"]) & (a["copy"] == b["copy"])
    state = (F.when(F.col("found_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("sha256") != F.col("found_sha256"), "damaged")
             .when(F.col("offset") != F.col("_offset"), "moved").otherwise("ok"))
    checked = a.join(b, on, "full").select(F.coalesce("page_id", "_id").alias("page_id"), F.coalesce(a["copy"], b["copy"]).alias("copy"), F.coalesce(a["archive"], b["archive"]).alias("archive"), F.coalesce("ordinal", "_ordinal").alias("ordinal"), F.coalesce("offset", "_offset").alias("offset"), F.coalesce("n_bytes", "_n").alias("n_bytes"), "sha256", state.alias("state"), "found_sha256")
    return fine.unionByName(checked)


def _ranges(last_ordinal: int) -> int:
    """How many levels of ranges an archive of this size has."""
    n = 1
    while last_ordinal := last_ordinal // FAN:
        n += 1
    return n - 1
