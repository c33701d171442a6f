"""Quality selection by importance resampling.

Two generative models over hashed n-grams: the target is the text of documents labelled good
(quality 1, not toxic), the raw model the text of all documents. An n-gram is a word or sign,
the first four or five letters of a word, or any word four times in a row; a document counts each n-gram once, so repeated
lines don't weigh more. The log ratio of the two, with ``SMOOTH`` pseudo-counts, is the evidence
of an n-gram; ratios within ``DEAD_ZONE`` of one, and counts within ``DEVIATIONS`` standard
deviations of what the raw model expects, are sampling noise and count as none. The sum over a
document is its log importance weight.

The number of documents to draw, k, is the number whose weight reaches the cut that best
separates the labelled documents. The draw is Gumbel top-k: the k largest of weight /
``TEMPERATURE`` plus Gumbel noise, which is sampling without replacement in proportion to the
tempered weights. The k-th largest key is found digit by digit from small histograms; nothing
is sorted as a whole.

Counts cover every document. The labels used are a hash sample of ``LABEL_ROWS`` at most,
which is what may be broadcast.

Defined cases: a NULL or empty text has weight 0; without good labels every document is kept;
several labels of one document count as the worst of them; a NULL label is no label; rows that repeat a
``doc_id`` and text are kept or rejected together; extra columns pass unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, free_names, text_or_empty, written

BUCKETS = 1 << 20  #: hash buckets of a model
SMOOTH = 3.0
DEAD_ZONE = 0.7
DEVIATIONS = 3.0
TEMPERATURE = 0.1
LABEL_ROWS = 400_000
AGAIN = 0  #: the bucket of all four-grams of one word
SLICE = 1 << 14  #: buckets that are summed in one row
KNOWN_WORDS = 200_000  #: words whose buckets a task remembers, some 60 MB


class NgramBuckets(dict):
    """Buckets of the n-grams of a word, remembered."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        from xxhash import xxh64_intdigest

        grams = [word]
        if len(word) > 4:
            grams += ["^" + word[:4], "^" + word[:5]]
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = tuple(xxh64_intdigest(g.encode("utf-8", "replace")) % BUCKETS for g in grams)
        return found


_SPLIT = re.compile(r"\w+|[^\w\s]+").findall


def ngrams(text: str, buckets: NgramBuckets) -> set[int]:
    """Buckets of the different n-grams of a text."""
    words = _SPLIT(text)
    found = set().union(*map(buckets.__getitem__, set(words)))
    if any(a == b == c == d for a, b, c, d in zip(words, words[1:], words[2:], words[3:], strict=False)):
        found.add(AGAIN)
    return found


def model_counts(docs: DataFrame) -> DataFrame:
    """``slice, n_raw, n_target`` : packed document counts of the buckets, summed per task before the shuffle.

    ``docs`` has ``text`` and ``good``; the last slice holds the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = NgramBuckets()
        total = np.zeros((2, BUCKETS + SLICE), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = ngrams(text.as_py(), buckets)
                at = np.fromiter(found, np.int64, len(found))
                total[0, at] += 1
                total[0, BUCKETS] += 1
                if good:
                    total[1, at] += 1
                    total[1, BUCKETS] += 1
        for low in range(0, BUCKETS + 1, SLICE):
            part = total[:, low:low + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([low // SLICE], pa.int64()), pa.array([part[0].tobytes()], pa.binary()), pa.array([part[1].tobytes()], pa.binary())], ["slice", "n_raw", "n_target"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the slices of this task: SLICE numbers each
        for batch in batches:
            for i, raw, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                more = np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in (raw, target)])
                sums[i] = sums[i] + more if i in sums else more
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([x[0].tobytes()], pa.binary()), pa.array([x[1].tobytes()], pa.binary())], ["slice", "n_raw", "n_target"])

    kind = "slice long, n_raw binary, n_target binary"
    return docs.mapInArrow(run, kind).repartition("slice").mapInArrow(add, kind)


def log_ratios(docs: DataFrame) -> np.ndarray:
    """The evidence of every bucket; all zero without good documents."""
    total = np.zeros((2, BUCKETS + SLICE))
    for row in model_counts(docs).collect():  # BUCKETS / SLICE + 1 rows
        low = row["slice"] * SLICE
        for k, x in enumerate((row["n_raw"], row["n_target"])):
            total[k, low:low + SLICE] += np.frombuffer(x, np.int64)
    n_raw, n_target = total[:, BUCKETS]
    if not n_target:
        return np.zeros(BUCKETS)
    expected = total[0, :BUCKETS] * (n_target / n_raw)
    ratio = np.log((total[1, :BUCKETS] + SMOOTH) / (expected + SMOOTH))
    noise = np.sqrt(np.maximum(expected * (1 - n_target / n_raw), 1e-9))
    ratio[(np.abs(ratio) < DEAD_ZONE) | (np.abs(total[1, :BUCKETS] - expected) < DEVIATIONS * noise)] = 0
    return ratio


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The columns of ``docs`` but ``text`` with the log importance ``weight``."""
    at = np.flatnonzero(ratios)
    shared = docs.sparkSession.sparkContext.broadcast((at, ratios[at]))  # BUCKETS numbers at most
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = NgramBuckets()
        evidence = dict(zip(*(x.tolist() for x in shared.value), strict=True))
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")):
                found = ngrams(text.as_py(), buckets)
                out.append(float(sum(evidence[x] for x in sorted(found & evidence.keys()))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.float64())], [*keep, "weight"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{kinds}, weight double")


def best_cut(scored: DataFrame) -> float | None:
    """The weight that best separates good from other labelled rows (``weight, good``); None without both."""
    tenth = F.round(F.greatest(F.least(F.col("weight"), F.lit(50.0)), F.lit(-50.0)), 1)
    rows = scored.where("good IS NOT NULL").groupBy(tenth.alias("w")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n")).collect()  # 1001 rows at most
    rows.sort(key=lambda r: r["w"])
    good, bad = sum(r["good"] for r in rows), sum(r["n"] - r["good"] for r in rows)
    if not good or not bad:
        return None
    best, cut, below_good, below_bad = -1.0, None, 0, 0
    for r in rows:
        gain = (good - below_good) / good + below_bad / bad
        if gain > best:
            best, cut = gain, r["w"] - 0.05
        below_good += r["good"]
        below_bad += r["n"] - r["good"]
    return cut


def kth_largest(df: DataFrame, digits: list[Column], k: int) -> Column:
    """The condition that a row is among the ``k`` with the largest digits, read from left to right.

    Each digit has a bounded number of values; one histogram of it is taken at a time, among the
    rows that agree with the digits chosen so far. Rows that agree in all digits stay together.
    """
    chosen, same = F.lit(False), F.lit(True)
    for digit in digits:
        rows = sorted(df.where(same).groupBy(digit.alias("d")).count().collect(), key=lambda r: -r["d"])
        for r in rows:
            if k < r["count"]:
                break
            k -= r["count"]
        else:
            return chosen | same
        chosen = chosen | (same & (digit > F.lit(r["d"])))
        same = same & (digit == F.lit(r["d"]))
        if k == 0:
            return chosen
    return chosen | same


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 29, label_rows: int = LABEL_ROWS) -> DataFrame:
    """``doc_id, weight, kept, text_key`` of every row of ``docs``, given ``labels`` (``doc_id, quality, toxic``)."""
    spark = docs.sparkSession
    per_doc = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    known = written(per_doc.select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("good")), "labels")
    n = known.count()
    if n > label_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(0.9 * label_rows / n * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(known.limit(label_rows)), "doc_id", "left")
    with arrow_bytes(spark):
        ratios = log_ratios(rows.select("text", "good"))
        scored = written(weights(rows.withColumn("text_key", F.xxhash64("text")), ratios), "weights")
    cut = best_cut(scored)
    if cut is None:
        return scored.select("doc_id", "weight", F.lit(True).alias("kept"), "text_key")
    k = scored.where(F.col("weight") >= cut).count()
    # Noise by hash: the same row draws the same number wherever and however often it is computed.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11) + 0.5) / F.lit(float(1 << 53))
    key = F.greatest(F.least(F.col("weight") / TEMPERATURE - F.log(-F.log(u)), F.lit(2000.0)), F.lit(-2000.0))
    fixed = F.floor((key + 2000) * float(1 << 32)).cast("long")
    tie = F.xxhash64(F.lit(seed + 1), "doc_id", "text_key")
    keyed = scored.withColumns({"fixed": fixed, "tie": tie})
    digits = [F.shiftright("fixed", 30), F.shiftright("fixed", 15).bitwiseAND(F.lit(32767)), F.col("fixed").bitwiseAND(F.lit(32767))]
    digits += [F.shiftright("tie", 48), *(F.shiftright("tie", s).bitwiseAND(F.lit(65535)) for s in (32, 16, 0))]
    kept = kth_largest(keyed, digits, k) if k else F.lit(False)
    return keyed.select("doc_id", "weight", kept.alias("kept"), "text_key")


def keep_drawn(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    i, k = free_names(docs, "_id", "_key")
    out = resampled(docs, labels, **options).where("NOT kept").select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text_or_empty()) == F.col(k))
    return docs.join(out, same, "left_anti")
