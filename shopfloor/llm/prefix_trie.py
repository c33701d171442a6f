r"""Trie of conversation prefixes with count-min screening.

A node is a distinct sequence of the first d turns (role, text); the root has none. A turn is
reduced to its SHA-256, a prefix to 128 bits: the exclusive or of SHA-256(depth, turn) over its
turns. This is built from both ends of any cut, so a conversation of any length is worked on in
pieces, and the digest of a parent is the digest of the child without its last turn.

1. Screening. A count-min sketch counts the prefixes of all conversations. It never counts too
   little: a prefix with an estimate of one is in one conversation only. Such tails are
   emitted where they are, with all their values known (one member, one leaf, nothing saved).
   The sketch may fail to prove it of a prefix below a proven one; such a node's parent is a tail of the
   same conversation.
2. Exact grouping. Only the other prefixes are shuffled, combined in their task first.
3. Sums over subtrees need no walk. A node belongs to the smallest of its conversations, the
   owner; a conversation owns the nodes from some depth down. What a subtree holds is the sum over
   its members of what each owns, less what the node's own owner owns above it.

The sketch has ``CELLS`` counters a row at most and is broadcast; beyond what it can tell apart more prefixes
are shuffled, with the same result.

Defined cases: a NULL role or text is empty; rows without a ``conv_id`` belong to no conversation; turns are
ordered by ``turn``, NULL first, repeated numbers by the digest of role and text; repeated rows
are turns of their own; an empty table has no node, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import text_or_empty, written
from shopfloor.llm.ordered import layout, running_by_piece

SKETCH_ROWS = 3
CELLS = 1 << 24  #: counters of one row of the sketch at most
SLICE = 1 << 16  #: counters that travel in one row
ENDS = 16  #: bits of the ids that are joined in one text
HOT_PARENTS = 1000  #: a node with more than 1 / HOT_PARENTS of all children is joined by broadcast


def turn_digest() -> Column:
    """The digest of a turn; the length keeps role and text apart."""
    role = text_or_empty("role")
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text_or_empty()), 256)


def paths(conversations: DataFrame, head: Column | None = None, lender: Column | None = None) -> DataFrame:
    """``conv_id, piece, depth, turn_digest, n_words, length`` of every turn, depth from 1; and per conversation a row of depth 0.

    With ``head`` and ``lender`` (both of ``conv_id``; heads of 3 turns at most) a conversation
    is rebuilt: the first ``head`` turns are those of the conversation ``lender``, as far as it
    has them, and its own follow from the same place on.
    """
    named = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(turn_digest()).alias("turn_digest"),
        F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    rows, pieces = layout(written(named, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("turn_digest").asc()], "turns-laid")
    pieces = written(pieces, "pieces")
    head = F.lit(0) if head is None else head
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", head.cast("long").alias("head"), (F.col("conv_id") if lender is None else lender).alias("lender"))
    has = convs.select(F.col("conv_id").alias("lender"), F.col("n").alias("lent"))
    convs = convs.join(has, "lender", "left").withColumn("taken", F.least("head", F.coalesce("lent", F.lit(0))))
    convs = written(convs.select("conv_id", "lender", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")), "conversations")
    place = F.col("before") + F.col("local") - F.col("first")
    own = rows.join(pieces.join(convs, "conv_id"), ["conv_id", "piece"]).withColumn("place", place).where("place >= head")
    own = own.select("conv_id", "piece", (F.col("place") - F.col("head") + F.col("taken") + 1).alias("depth"), "turn_digest", "n_words", "length")
    first = rows.join(pieces.where("before < 3"), ["conv_id", "piece"]).withColumn("place", place).where("place < 3")
    first = first.select(F.col("conv_id").alias("lender"), (F.col("place") + 1).alias("depth"), "turn_digest", "n_words")
    lent = convs.where("taken > 0").join(first, "lender").where("depth <= taken")
    lent = lent.select("conv_id", F.lit(-1).cast("long").alias("piece"), "depth", "turn_digest", "n_words", "length")
    root = convs.select("conv_id", F.lit(-2).cast("long").alias("piece"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_words"), "length")
    return own.unionByName(lent).unionByName(root)


def prefixes(turns: DataFrame) -> DataFrame:
    """The rows of :func:`paths` with the prefix digest ``a, b`` and that of the parent ``up_a, up_b``."""
    mark = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.hex("turn_digest")), 256)
    half = [F.when(F.col("depth") > 0, F.conv(F.substring(mark, at, 16), 16, -10).cast("long")).otherwise(F.lit(0).cast("long")) for at in (1, 17)]
    marked = turns.withColumns({"mark_a": half[0], "mark_b": half[1]})
    out = running_by_piece(marked, F.bit_xor, {"mark_a": "up_a", "mark_b": "up_b"}, "conv_id", "depth")
    return out.withColumns({"a": F.col("up_a").bitwiseXOR(F.col("mark_a")), "b": F.col("up_b").bitwiseXOR(F.col("mark_b"))}).drop("mark_a", "mark_b")


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each prefix in every row of the sketch."""
    step = b | np.uint64(1)
    return np.stack([(a + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(SKETCH_ROWS)]).astype(np.int64)


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Counts of ``a, b`` up to two, a row of 2**``bits`` counters for each of ``SKETCH_ROWS`` hashes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_ROWS << bits, np.uint8)
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            at = _cells(a, b, bits) + (np.arange(SKETCH_ROWS) << bits)[:, None]
            cell, n = np.unique(at, return_counts=True)
            total[cell] = np.minimum(total[cell] + np.minimum(n, 2).astype(np.uint8), 2)
        for low in range(0, len(total), SLICE):
            part = total[low:low + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([low // SLICE], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the slices of this task
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(counts), np.uint8)
                sums[k] = np.minimum(sums[k] + more, 2) if k in sums else more
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    kind = "slice long, counts binary"
    total = np.zeros(SKETCH_ROWS << bits, np.uint8)
    for row in rows.select("a", "b").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
        total[row["slice"] * SLICE:row["slice"] * SLICE + len(part)] = part
    return total


def screened(rows: DataFrame, most: int = CELLS) -> DataFrame:
    """The rows with ``alone`` and ``up_alone``: the prefix, or its parent's, is proven to be in one conversation only."""
    turns = rows.where("depth > 0")
    bits = min(most.bit_length() - 1, max(12, (4 * turns.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(sketch(turns, bits))  # SKETCH_ROWS * CELLS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shared.value.reshape(SKETCH_ROWS, -1)
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            depth = named["depth"].to_numpy(zero_copy_only=False)
            flags = []
            for x, y, least in (("a", "b", 1), ("up_a", "up_b", 2)):
                at = _cells(*(named[k].to_numpy(zero_copy_only=False).view(np.uint64) for k in (x, y)), bits)
                estimate = np.min([total[k][at[k]] for k in range(SKETCH_ROWS)], axis=0)
                flags.append(pa.array((estimate == 1) & (depth >= least)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], [*batch.schema.names, "alone", "up_alone"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, alone boolean, up_alone boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of the shared prefixes that some conversation ends with: ids in ascending order, hashed as they pass."""
    block = F.shiftright("conv_id", ENDS)  # an id occurs once a node, so a block has 2**ENDS ids at most
    texts = rows.where("depth = length").groupBy("a", "b", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["a", "b", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["a", "b", "ends_sha256"])

    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(run, "a long, b long, ends_sha256 string")


def _with_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with ``parent_conv_id``; nodes that hold many children are joined by broadcast, the rest by a shuffle."""
    up = parents.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    hot = F.col("n_children") * HOT_PARENTS > parents.agg(F.sum("n_children")).scalar()
    many, few = F.broadcast(up.where(hot).drop("n_children")), up.where(~hot).drop("n_children")  # HOT_PARENTS at most
    return children.join(many, ["up_a", "up_b"]).unionByName(children.join(many, ["up_a", "up_b"], "left_anti").join(few, ["up_a", "up_b"]))


def trie(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of the conversations in :func:`paths`: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_digest``.

    ``conv_id`` is the smallest member of a node, ``turn_digest`` (see :func:`turn_digest`) tells its last turn.
    """
    rows = written(screened(written(prefixes(turns), "prefixes"), cells), "screened")
    shared, alone = rows.where("NOT alone"), rows.where("alone")
    same = [F.max(c).alias(c) for c in ("depth", "up_a", "up_b", "up_alone", "n_words", "turn_digest")]  # equal in all rows of a node
    grouped = shared.groupBy("a", "b").agg(F.min(F.struct("conv_id", "piece")).alias("owner"), F.count("*").alias("n_convs"), *same)
    nodes = grouped.select("a", "b", "owner.*", "depth", "up_a", "up_b", "up_alone", "turn_digest", "n_convs", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    nodes = written(nodes, "nodes")
    tops = alone.where("NOT up_alone").select("conv_id", "depth", "length", "up_a", "up_b", "turn_digest")
    up = [F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where("depth > 0").select(*up).unionByName(tops.select(*up)).groupBy("a", "b").agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")

    # What each conversation owns: its shared nodes' savings, and the leaf it is the smallest member of.
    zero = F.lit(0).cast("long")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    owned = nodes.select("conv_id", "saved", leaf.alias("leaf")).unionByName(alone.where("depth = length").select("conv_id", zero.alias("saved"), F.lit(1).cast("long").alias("leaf")))
    owned = owned.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    by_piece = shared.select("conv_id", "piece").distinct().join(owned, "conv_id")
    sums = shared.select("conv_id", "piece", "a", "b").join(by_piece, ["conv_id", "piece"]).groupBy("a", "b").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("n_leaves"))
    above = running_by_piece(nodes, F.sum, {"saved": "above"}, "conv_id", "depth")
    none = F.sha2(F.lit("").cast("binary"), 256)
    full = above.join(sums, ["a", "b"], "left").join(_ends(shared), ["a", "b"], "left")
    full = full.withColumns({"saved_tokens": F.col("all_saved") - F.col("above"), "ends_sha256": F.coalesce("ends_sha256", none)})
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_digest"]
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out)
    inner = _with_parent(full.where("depth > 0 AND NOT up_alone"), nodes).select(*out)
    below_tail = full.where("up_alone").withColumn("parent_conv_id", F.col("conv_id")).select(*out)

    one = F.lit(1).cast("long")
    last = F.col("depth") == F.col("length")
    known = {"n_convs": one, "n_children": F.when(last, zero).otherwise(one), "n_leaves": one, "saved_tokens": zero,
             "ends_sha256": F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none)}
    tails = alone.where("up_alone").withColumn("parent_conv_id", F.col("conv_id")).withColumns(known).select(*out)
    return root.unionByName(inner).unionByName(below_tail).unionByName(_with_parent(tops, nodes).withColumns(known).select(*out)).unionByName(tails)
