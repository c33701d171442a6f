"""Near-duplicate groups by SimHash, found with generalised pigeonhole partitions.

Fingerprints that differ in at most ``max_bits`` bits are linked. The 64 bits are put into
partitions of correlated bits; partition i gets a threshold t_i (-1: not probed) such that
the sum of (t_i + 1) is ``max_bits + 1``, so two linked fingerprints differ in at most t_i
bits of some partition i. Dynamic programming picks the thresholds with the fewest candidate pairs and probes, both
worked out from the counts of the partition's values for every threshold up to its width. A fingerprint is probed under the bits of each partition, with every choice of
t_i of them masked, and each bucket verifies the full distance.

A bucket of more than ``BUCKET`` different fingerprints is not compared pair by pair: its
free bits are split again by the same principle (thresholds of zero), level by level, until the
buckets are small. Buckets yield a spanning forest of their links, never all pairs.

Defined cases: a NULL or blank text has fingerprint 0 and is linked like any other; a text of
fewer words than a shingle is one shingle; equal texts share a fingerprint; a group of rows
without any ``doc_id`` has a NULL component; an empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, free_names, let_go, text_or_empty, written
from shopfloor.llm.components import components

PARTITIONS = 4
BUCKET = 8192  #: different fingerprints that are compared within one bucket (64 kB of them)


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text as a signed 64-bit number: a bit is set if over half the shingles have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = (np.cumsum(size + 1) - size - 1).tolist()
    end = (np.cumsum(size + 1) - 1).tolist()
    joined = b" ".join(words)
    last = end[min(shingle, len(words)) - 1:]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[:n], last, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _unsigned(mask: int) -> int:
    return mask & (2**64 - 1)


def _signed(mask: int) -> int:
    mask = _unsigned(mask)
    return mask - 2**64 if mask >> 63 else mask


def correlated_groups(together: np.ndarray, n: int, groups: int = PARTITIONS) -> list[list[int]]:
    """Bits in equal groups: each starts with the strongest pair left and takes the most correlated bits."""
    share = together / max(1, n)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = np.abs((share - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, -1)
    left, out = list(range(64)), []
    for g in range(groups):
        size = 64 // groups + (g < 64 % groups)
        sub = corr[np.ix_(left, left)]
        a, b = np.unravel_index(int(np.argmax(sub)), sub.shape) if len(left) > 1 else (0, 0)
        group = list(dict.fromkeys([left[a], left[b]]))[:size]
        while len(group) < size:
            rest = [x for x in left if x not in group]
            group.append(max(rest, key=lambda x: corr[x, group].sum()))
        left = [x for x in left if x not in group]
        out.append(sorted(group))
    return out


def co_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each pair of bits is set together, and the number of fingerprints: 64 x 64 sums per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64 * 64 + 1), pa.int64()), pa.array(np.append(total.ravel(), n).astype(np.int64), pa.int64())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(64 * 64 + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return flat[:-1].reshape(64, 64), int(flat[-1])


def pairs_by_distance(bits: list[int], values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ordered pairs of rows, each with itself too, by the number of ``bits`` in which their values differ.

    How often two values differ by a given pattern is the counts' correlation with themselves over exclusive or: the
    square of their Walsh-Hadamard transform, transformed back.
    """
    width = len(bits)
    cell = np.zeros(len(values), np.int64)
    for k, b in enumerate(bits):
        cell |= (values >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
    spectrum = np.bincount(cell, counts, 1 << width)
    for back in (False, True):
        for k in range(width):
            halves = spectrum.reshape(-1, 2, 1 << k)
            spectrum = np.stack([halves[:, 0] + halves[:, 1], halves[:, 0] - halves[:, 1]], 1).reshape(-1)
        spectrum = spectrum / (1 << width) if back else spectrum**2
    return np.bincount(np.bitwise_count(np.arange(1 << width)), spectrum, width + 1)


def probe_costs(bits: list[int], values: np.ndarray, counts: np.ndarray) -> list[float]:
    """By threshold t: candidate pairs of a partition probed by all its bits but t, however the t are chosen, and the probes."""
    width, n = len(bits), float(counts.sum())
    pairs = pairs_by_distance(bits, values, counts)
    pairs[0] -= n
    return [sum(float(pairs[d]) / 2 * comb(width - d, t - d) for d in range(t + 1)) + comb(width, t) * n for t in range(width + 1)]


def allocate(histograms: list[tuple[list[int], np.ndarray, np.ndarray]], max_bits: int) -> list[int]:
    """Thresholds of the partitions (bits, masked values, their counts) by dynamic programming on candidate pairs.

    Each is -1 (not probed) to the width of its partition; they add up, with one for each partition, to ``max_bits`` + 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, values, counts in histograms:
        step: dict[int, tuple[float, list[int]]] = {}
        costs = {-1: 0.0} | dict(enumerate(probe_costs(bits, values, counts)[:max_bits + 1]))
        for used, (so_far, chosen) in best.items():
            for t, c in costs.items():
                if used + t + 1 <= max_bits + 1 and (used + t + 1 not in step or so_far + c < step[used + t + 1][0]):
                    step[used + t + 1] = (so_far + c, [*chosen, t])
        best = step
    return best[max_bits + 1][1]


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each group of linked fingerprints: the others and the one they hang on."""
    unseen = fps
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        queue, members = [root], []
        while queue and len(unseen):
            near = np.bitwise_count(unseen ^ queue.pop()) <= max_bits
            if near.any():
                found, unseen = unseen[near], unseen[~near]
                members.append(found)
                queue.extend(found)
        if members:
            yield np.concatenate(members), root


def _links(buckets: DataFrame, max_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fps in batch.column(0):
                for members, root in _forest(fps.values.to_numpy().view(np.uint64), max_bits):
                    left.append(members.view(np.int64))
                    right.append(np.full(len(members), root, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["u", "v"])

    return buckets.mapInArrow(run, "u long, v long")


def _gathered(level: DataFrame) -> DataFrame:
    """The fingerprints of each bucket that holds more than one; no bucket of ``level`` is large."""
    return level.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")


def _of_masks(fps: DataFrame, masks: list[int]) -> DataFrame:
    each = F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)))
    return fps.select("fp", each.alias("mask"))


def links(fps: DataFrame, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """A spanning set of the links between the distinct fingerprints ``fp``: columns ``u``, ``v``."""
    spark = fps.sparkSession
    together, n = co_counts(fps)
    groups = correlated_groups(together, n)
    histograms = []
    for bits in groups:
        mask = sum(1 << b for b in bits)
        rows = fps.groupBy(F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("value")).count().toPandas()  # 2**16 rows at most
        histograms.append((bits, rows["value"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.float64)))
    masks = []
    for (bits, _, _), t in zip(histograms, allocate(histograms, max_bits), strict=True):
        if t >= 0:
            whole = sum(1 << b for b in bits)
            masks += [whole & ~sum(1 << b for b in out) for out in combinations(bits, t)]
    level, found = _of_masks(fps, masks), []
    while True:
        level = level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = level.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        big = written(sizes.select("mask", "value", F.lit(True).alias("big")), "big-buckets")
        if big.isEmpty():
            found.append(written(_links(_gathered(level), max_bits), "links"))
            break
        # Written before it is grouped, so that the join may split a bucket with a large share of the rows.
        level = written(level.join(big, ["mask", "value"], "left"), "told-buckets")
        found.append(written(_links(_gathered(level.where("big IS NULL")), max_bits), "links"))
        finer = [(m, child) for m in (r["mask"] for r in big.select("mask").distinct().collect()) for child in _finer(m, max_bits)]
        children = spark.createDataFrame(finer, "mask long, child long")  # as many rows as there are masks, not data
        again = level.where("big").select("fp", "mask")
        level = written(again.join(F.broadcast(children), "mask").select("fp", F.col("child").alias("mask")).distinct(), "finer")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _finer(mask: int, max_bits: int) -> list[int]:
    """The masks that add one part of the free bits each: linked fingerprints agree on one of them."""
    free = [b for b in range(64) if not _unsigned(mask) >> b & 1]
    n = max_bits + 1
    if len(free) <= n:  # at most 2 ** n different fingerprints
        return []
    return [_signed(_unsigned(mask) | sum(1 << b for b in free[i::n])) for i in range(n)]


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id, label`` per row: component_id is the smallest doc_id reachable over links.

    ``label`` names the group even where no row of it has a ``doc_id``.
    """
    spark = docs.sparkSession
    with arrow_bytes(spark):
        rows = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), max_bits, bucket))
    labels = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = written(labels.join(smallest, "label").select("fp", "label", "component_id"), "labels")
    let_go(spark)
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id", "label")


def hex_digits(fp: Column | str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group stays: the one with the smallest ``doc_id``.

    Of rows that repeat this ``doc_id``, and of a group without any, one row stays.
    """
    groups = simhash_groups(docs, shingle, max_bits)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    unique = stays.groupBy("doc_id").count().where("count > 1").isEmpty()
    i, p, g, own, rest, row = free_names(docs, "_id", "_fp", "_label", "_own", "_rest", "_row")
    keys = stays.select(F.col("doc_id").alias(i), F.col("fp").alias(p), F.col("label").alias(g)).distinct()
    if unique and stays.where("doc_id IS NULL").isEmpty():
        return docs.join(keys.select(i), F.col("doc_id").cast("long") == F.col(i), "left_semi")
    # Some rows share a doc_id: tell their texts apart by fingerprint, then keep one row of a group, the
    # first by a hash of all its columns and by its number. The rows are written with both, so that every task reads the same ones.
    all_columns = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    shared = fingerprint_column(docs, shingle, own).withColumns({rest: F.xxhash64(*all_columns), row: F.monotonically_increasing_id()})
    picked = written(shared.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(p))), "candidates")
    order = F.struct(rest, row)
    first = picked.groupBy(g).agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(f"{row}_first"))
    return picked.join(first, F.col(row) == F.col(f"{row}_first"), "left_semi").select(*docs.columns)


def fingerprint_column(docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """``docs`` with its fingerprint as ``name``."""
    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: fingerprint(bytes(x), shingle))

    return docs.withColumn(name, own(text_or_empty().cast("binary")))
