"""Merkle manifest of a data set, with SHA-256 midstates kept in the tree.

Every row is a leaf. The leaves of a source, by ``doc_id``, are merged in runs of ``FAN``, level
by level, until one node is left, the subroot; the subroots, by source, give the root alike. A
node is the SHA-256 of its children's digests as hex text: a child is 64 bytes, just one block of
the hash, so a parent can keep a copy of the hash state before each child (``midstates``).
Folding a changed leaf resumes the state before its place with the replacement and the siblings
to its right; what is left of it is never hashed again. A proof goes on from the state it has
reached in the same way.

The work goes by blocks of ``FAN`` ** ``LEVELS`` neighbours of a source: a task builds the lower
levels of a block and takes every leaf up to the top of its block. The tops are the leaves of the
next tier, with a ``FAN`` ** ``LEVELS``-th of the nodes. The way above a block is the same for all its
leaves, so it is handed down the tiers by block: per level the midstate before its place and the
run's digests. Many blocks are hashed side by side in numpy arrays.

Defined cases: a NULL field is ``-``; rows are ordered by ``doc_id``, NULL first, repeated ones by
leaf; a NULL source is a source and comes first; a lone leaf is its subroot, a lone subroot the
root; an empty table gives an empty result. Extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import text_or_empty, written
from shopfloor.llm.ordered import layout

FAN = 16
LEVELS = 3  #: levels that one task builds over a block
BLOCK = FAN**LEVELS
BATCH = 1 << 14  #: nodes that are hashed side by side, whole blocks
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    """Start state and round constants of SHA-256: fractions of the square and cube roots of the first primes."""
    primes = [n for n in range(2, 312) if all(n % k for k in range(2, int(n**0.5) + 1))]

    def root(n: int, power: int) -> int:
        low, high = 0, 1 << 40
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if middle**power <= n << 32 * power else (low, middle)
        return low & 0xFFFFFFFF

    return np.array([root(p, 2) for p in primes[:8]], np.uint32), np.array([root(p, 3) for p in primes], np.uint32)


def start(n: int) -> np.ndarray:
    """The state before any block, ``n`` times (8 words a row)."""
    return np.tile(_constants()[0], (n, 1))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states after one more block each (rows of 16 big-endian words as numbers)."""
    w = [np.ascontiguousarray(blocks[:, i], np.uint32) for i in range(16)]
    a, b, c, d, e, f, g, h = old = [np.ascontiguousarray(states[:, i]) for i in range(8)]

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x >> np.uint32(n)) | (x << np.uint32(32 - n))

    for i, k in enumerate(_constants()[1]):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + ((e & f) ^ (~e & g)) + k + w[i]
        two = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip(old, (a, b, c, d, e, f, g, h), strict=True)], axis=1)


def finish(states: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """The digests (8 words a row) of messages of whole blocks, so many each."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 14], last[:, 15] = n_blocks >> 23, (n_blocks << 9) & 0xFFFFFFFF
    return absorb(states, last)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (8 words a row) as hex text, which is one block each."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(-1, 32)
    text = np.stack([_HEX[raw >> 4], _HEX[raw & 15]], axis=2).reshape(-1, 64)
    return np.ascontiguousarray(text).view(">u4").astype(np.uint32)


def _words(column: pa.Array | Sequence[bytes]) -> np.ndarray:
    data = b"".join(column if isinstance(column, list) else column.to_pylist())
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, 8)


def _binary(words: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in words.astype(">u4")]


def midstates(blocks: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each child of the runs (``run`` numbers a child's run, ascending), and the digests of the runs."""
    first = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(np.append(first, len(run)))
    before = np.empty((len(run), 8), np.uint32)
    state = start(len(first))
    for slot in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > slot)
        before[first[here] + slot] = state[here]
        state[here] = absorb(state[here], blocks[first[here] + slot])
    return before, finish(state, size)


def _fold(digest: np.ndarray, before: np.ndarray, slot: np.ndarray, size: np.ndarray, right: "np.ndarray", first: np.ndarray) -> np.ndarray:
    """The parents' digests with ``digest`` in the place of the child ``slot``: the state before it goes on with it and the children to its right."""
    state = absorb(before, as_blocks(digest))
    for k in range(1, int(size.max(initial=0))):
        here = np.flatnonzero((k > slot) & (k < size))
        if len(here):
            state[here] = absorb(state[here], right[first[here] + k])
    return finish(state, size)


def _prove(proof: np.ndarray, slot: np.ndarray, size: np.ndarray, children: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The proofs' states after the siblings of the run, from left to right."""
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero((k != slot) & (k < size))
        if len(here):
            proof[here] = absorb(proof[here], children[first[here] + k])
    return proof


def _level(nodes: np.ndarray, block: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """One level over nodes in order: run by run the first child, its size, the midstates and the digests."""
    run = np.cumsum((np.diff(block, prepend=block[:1] - 1) != 0) | (place % FAN == 0)) - 1
    hexed = as_blocks(nodes)
    before, digests = midstates(hexed, run)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    return {"run": run, "hex": hexed, "before": before, "digest": digests, "first": first, "size": np.diff(np.append(first, len(run)))}


def _blocks(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of about ``BATCH`` at a time, cut where ``by`` changes."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.Table]:
        nonlocal held
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [rows.column(c).to_pylist() for c in by]
        end = rows.num_rows
        if not last:
            end -= 1
            while end and all(k[end - 1] == k[-1] for k in keys):
                end -= 1
            held = rows.slice(end).to_batches()
        if end:
            yield rows.slice(0, end)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) >= BATCH:
                yield from cut(False)
    if held:
        yield from cut(True)


def _numbers(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number for each row that goes up where one of the columns changes."""
    change = np.zeros(rows.num_rows, bool)
    for c in names:
        values = rows.column(c).to_pylist()
        change[1:] |= np.fromiter((x != y for x, y in zip(values[1:], values, strict=False)), bool, rows.num_rows - 1)
    return np.cumsum(change)


def _climb(rows: pa.Table, folded: np.ndarray, proof: np.ndarray, seen: np.ndarray, ways: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Take every node of whole blocks to the top of its block.

    Returns the block number of each row, the blocks' tops, the folded digests, the proofs' states
    and how many siblings they hold; with ``ways`` also each row's way up: per level a tuple of
    (midstate, slot, run's digests).
    """
    block = _numbers(rows, ["grp", "block"])
    lone = ~np.asarray(rows.column("many").to_pylist(), bool)  # the only block of its group: up to one node
    nodes, of, place = _words(rows.column("digest")), block, np.asarray(rows.column("place"), np.int64) % BLOCK
    single = lone[np.flatnonzero(np.diff(block, prepend=-1))]
    at = np.arange(rows.num_rows)  # the node above each row
    way: list[list] = [[] for _ in range(rows.num_rows)] if ways else []
    for _ in range(LEVELS):
        count = np.bincount(of)
        active = ~single[of] | (count[of] > 1)  # nodes of a lone block that is down to one stay
        if not active.any():
            break
        x = _level(nodes[active], of[active], place[active])
        local = np.cumsum(active) - 1
        moved = np.flatnonzero(active[at])
        here = local[at[moved]]
        run = x["run"][here]
        slot, size, first = here - x["first"][run], x["size"][run], x["first"][run]
        if ways:
            for i, j, r, s in zip(moved.tolist(), here.tolist(), run.tolist(), slot.tolist(), strict=True):
                low = int(x["first"][r])
                way[i].append((x["before"][j].astype(">u4").tobytes(), s, nodes[active][low:low + int(x["size"][r])].astype(">u4").tobytes()))
        else:
            folded[moved] = _fold(folded[moved], x["before"][here], slot, size, x["hex"], first)
            proof[moved] = _prove(proof[moved], slot, size, x["hex"], first)
            seen[moved] += size - 1
        # The next level: the runs' digests, and the nodes that stay, in order.
        heads = np.flatnonzero(active)[x["first"]]
        stay = np.flatnonzero(~active)
        keep = np.sort(np.concatenate([heads, stay]))
        new = nodes[keep]
        new[np.searchsorted(keep, heads)] = x["digest"]
        above = np.empty(len(nodes), np.int64)
        above[np.flatnonzero(active)] = np.searchsorted(keep, heads)[x["run"]]
        above[stay] = np.searchsorted(keep, stay)
        at, nodes, of, place = above[at], new, of[keep], place[keep] // FAN
    return block, nodes, folded, proof, seen, way


_WAY = "array<struct<midstate:binary,slot:int,run:binary>>"
_WAY_ARROW = pa.list_(pa.struct([("midstate", pa.binary()), ("slot", pa.int32()), ("run", pa.binary())]))


def _lift_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches, ["grp", "block"]):
        n = rows.num_rows
        block, tops, folded, proof, seen, _ = _climb(rows, _words(rows.column("replacement")), start(n), np.zeros(n, np.int64), False)
        out = [rows.column(c).combine_chunks() for c in ("id", "grp", "block", "digest")]
        out += [pa.array(_binary(folded), pa.binary()), pa.array(_binary(proof), pa.binary()), pa.array(seen), pa.array(_binary(tops[block]), pa.binary())]
        yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], ["id", "grp", "block", "digest", "folded", "proof", "seen", "top"])


def _lift_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches, ["grp", "block"]):
        n = rows.num_rows
        block, tops, _, _, _, way = _climb(rows, np.zeros((n, 8), np.uint32), start(n), np.zeros(n, np.int64), True)
        ways = pa.array([[{"midstate": m, "slot": s, "run": r} for m, s, r in x] for x in way], _WAY_ARROW)
        yield pa.RecordBatch.from_arrays([rows.column("grp").combine_chunks(), rows.column("place").combine_chunks(), rows.column("block").combine_chunks(), pa.array(_binary(tops[block]), pa.binary()), ways], ["grp", "place", "block", "top", "way"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take every leaf from the top of its block to the root by the way of the block."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        folded, proof = _words(named["folded"]), _words(named["proof"])
        seen = named["seen"].to_numpy(zero_copy_only=False).copy()
        ways = named["way"].to_pylist()
        for level in range(max(map(len, ways))):
            here = np.array([i for i, x in enumerate(ways) if len(x) > level])
            steps = [ways[i][level] for i in here]
            size = np.array([len(x["run"]) // 32 for x in steps])
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            children = as_blocks(_words([x["run"] for x in steps]))
            slot = np.array([x["slot"] for x in steps])
            folded[here] = _fold(folded[here], _words([x["midstate"] for x in steps]), slot, size, children, first)
            proof[here] = _prove(proof[here], slot, size, children, first)
            seen[here] += size - 1
        out = [pa.array(_binary(x), pa.binary()) for x in (folded, finish(proof, seen))]
        yield pa.RecordBatch.from_arrays([named["id"], named["digest"], named["subroot"], named["root"], *out], ["id", "leaf", "subroot", "root", "folded_root", "proof"])


def _tiers(tops: DataFrame, last: int) -> DataFrame:
    """From ``grp, place, digest`` (nodes by place in their group, ``last`` the greatest) to ``grp, place, top, way``: the top node of the group and the way up to it."""
    block = F.shiftright("place", 4 * LEVELS)
    below = None  # per node of the first tier: its block and the way so far
    while True:
        many = F.lit(last >= BLOCK) & F.col("n_blocks").isNotNull() & (F.col("n_blocks") > 1)
        sizes = tops.groupBy("grp").agg(F.max(block + 1).alias("n_blocks")).select(F.col("grp").alias("_grp"), "n_blocks")
        rows = tops.withColumn("block", block).join(sizes, F.col("grp").eqNullSafe(F.col("_grp"))).withColumn("many", many).drop("_grp", "n_blocks")
        lifted = written(rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "place").mapInArrow(_lift_tops, f"grp string, place long, block long, top binary, way {_WAY}"), "tier")
        if below is None:
            below = lifted
        else:
            up = lifted.select(F.col("grp").alias("_grp"), F.col("place").alias("_place"), F.col("block").alias("_block"), F.col("top").alias("_top"), F.col("way").alias("_way"))
            joined = below.join(up, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_place")))
            below = written(joined.select("grp", "place", F.col("_block").alias("block"), F.col("_top").alias("top"), F.concat("way", "_way").alias("way")), "ways")
        if last < BLOCK:
            return below
        tops = lifted.groupBy("grp", "block").agg(F.min("top").alias("digest")).withColumnRenamed("block", "place")  # equal in all rows of a block
        last //= BLOCK


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as ``-`` if NULL, else its bytes' number, ``:`` and the field."""
    text = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None, order: str = "doc_id", group: str = "source") -> DataFrame:
    """``id, leaf, subroot, root, folded_root, proof`` (digests as bytes) of every row of ``docs``.

    ``changed`` gives fields of the copy that is audited; ``folded_root`` is the root with the
    copy's leaf in the row's place, ``proof`` the digest of the siblings from the leaf to the root.
    """
    columns = {f: F.col(f) for f in fields}
    digest = {"digest": F.unhex(leaf(list(columns.values()))), "replacement": F.unhex(leaf(list((columns | (changed or {})).values())))}
    leaves = written(docs.select(F.col(order).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), *(x.alias(k) for k, x in digest.items())), "leaves")
    rows, pieces = layout(leaves, "grp", [F.col("id").asc_nulls_first(), F.col("digest").asc()], "leaves-laid")
    pieces = written(pieces, "pieces")
    sizes = pieces.groupBy("grp").agg(F.sum("n").alias("n_rows"))
    most = sizes.agg(F.max("n_rows"), F.count("*")).first()
    if not most[0]:
        return leaves.select("id", *(F.col("digest").alias(x) for x in ("leaf", "subroot", "root", "folded_root", "proof")))
    at = pieces.join(sizes.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).select(F.col("grp").alias("_grp"), F.col("piece").alias("_piece"), "first", "before", (F.col("n_rows") > BLOCK).alias("many"))
    placed = rows.join(at, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("piece") == F.col("_piece"))).withColumn("place", F.col("before") + F.col("local") - F.col("first"))
    placed = placed.select("id", "grp", F.shiftright("place", 4 * LEVELS).alias("block"), "place", "many", "digest", "replacement")
    # A group of rows is a block: BLOCK rows at most, whatever the size of a source.
    lifted = written(placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "place").mapInArrow(_lift_leaves, "id long, grp string, block long, digest binary, folded binary, proof binary, seen long, top binary"), "lifted")
    tops = lifted.groupBy("grp", "block").agg(F.min("top").alias("digest")).withColumnRenamed("block", "place")  # equal in all rows of a block
    ways = _tiers(written(tops, "tops"), (most[0] - 1) // BLOCK)
    subroots = ways.where("place = 0").select("grp", F.col("top").alias("digest"))
    laid, cuts = layout(subroots.withColumn("all", F.lit("")).withColumnRenamed("grp", "name"), "all", [F.col("name").asc_nulls_first()], "subroots-laid")
    sources = laid.join(cuts, ["all", "piece"]).select("name", F.lit("").alias("grp"), (F.col("before") + F.col("local") - F.col("first")).alias("place"), "digest")
    sources = written(sources, "subroots")
    over = _tiers(sources.select("grp", "place", "digest"), most[1] - 1).select("place", F.col("top").alias("root"), F.col("way").alias("_over"))
    over = sources.select("name", "place").join(over, "place").drop("place")
    full = ways.join(over, F.col("grp").eqNullSafe(F.col("name"))).select(F.col("grp").alias("_grp"), F.col("place").alias("_place"), F.col("top").alias("subroot"), "root", F.concat("way", "_over").alias("way"))
    both = lifted.join(full, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_place")))
    return both.select("id", "digest", "subroot", "root", "folded", "proof", "seen", "way").mapInArrow(_finish, "id long, leaf binary, subroot binary, root binary, folded_root binary, proof binary")


def audit(docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, digests as hex text."""
    found = manifest(docs, changed=changed)
    text = {k: F.lower(F.hex(v)) for k, v in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof_sha256", "proof"), ("folded_root", "folded_root"))}
    return found.select(F.col("id").alias("doc_id"), *(x.alias(k) for k, x in text.items()), (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_case_some(one_in: int = 5) -> dict[str, Column]:
    """The copy whose texts are in lower case (A-Z) where ``one_in`` divides the checksum of the id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % one_in == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": F.when(hit, lower).otherwise(F.col("text"))}
