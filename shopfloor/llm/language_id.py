"""Language identification by interpolated Kneser-Ney models of characters, one per language.

A character is a letter in lower case, or a blank for all that lies between letters; four of them make a
64-bit key, so letters of all scripts are told apart (those beyond 16 bits share 6,400 codes). The
counts cover every document that may be learned from and are made in Spark, so the model grows with the
different four-grams of the text. Each order of a model is a sorted array of keys with one column per language;
the model is fitted from these counts on the driver and broadcast.

A text gets the language with the lowest cross-entropy per character. Two things are calibrated on one
learned fold, all its rows, by a model of the other learned folds, so on text that the model has not seen: the
score, a logistic curve over the margin to the second language, and the rejection: an entropy above
the ``REJECT`` quantile of the language's own documents is marked as ``rejected`` (the best language is
still named). A language without own documents in that fold takes the quantile of all its learned ones.
Quantiles are taken in Spark, to within a rank error of 1 / ``QUANTILE_ACCURACY``.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; if nothing can be
learned every text is ``und``; a NULL ``doc_id`` is neither held out nor learned from; repeated
rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, written

CHAR = 16  #: bits of a character
ORDER = 4
CALIBRATION_FOLD = 1  #: of the learned folds 1 to 4, the one that calibrates score and rejection
MARGIN_STEP = 1e-3  #: margins are counted in steps of this size
REJECT = 0.999
QUANTILE_ACCURACY = 100_000
UND = "und"

_TABLE: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """The 16-bit code of every code point: a letter's own, 0 for what is no letter; letters beyond 16 bits share the private ones."""
    if not _TABLE:
        point = np.arange(0x110000, dtype=np.uint64)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        far = np.uint64(0xE000) + (point * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(6400)
        _TABLE.append(np.where(letter, np.where(point < 0x10000, point, far), 0).astype(np.uint64))
    return _TABLE[0]


def keys_of(text: str | None) -> np.ndarray:
    """The four-grams of a text as 64-bit keys; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    c = _codes()[points]
    if not c.any():
        return np.zeros(0, np.uint64)
    c = np.concatenate([np.zeros(3, np.uint64), c[(c > 0) | (np.concatenate([[1], c[:-1]]) > 0)], np.zeros(1, np.uint64)])
    return c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def ngram_counts(docs: DataFrame) -> DataFrame:
    """``lang, key, n`` of the four-grams of ``docs`` (``text, lang``), merged per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def merge(lang: str) -> None:
            keys, counts = done.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            new, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            done[lang] = _merged(np.concatenate([keys, new]), np.concatenate([counts, n]))
            size[lang] = 0

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys = keys_of(text.as_py())
                waiting.setdefault(lang, []).append(keys)
                size[lang] = size.get(lang, 0) + len(keys)
                if size[lang] > 2_000_000:
                    merge(lang)
        for lang in list(waiting):
            merge(lang)
        for lang, (keys, counts) in done.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64), pa.int64()), pa.array(counts, pa.int64())], ["lang", "key", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would be in a sorted array, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << CHAR * order) - 1)


class KneserNey:
    """Interpolated Kneser-Ney models of all languages, each order in sorted arrays.

    ``grams[k]`` are the k-grams of any language and ``seen[k]`` what their own counts give by language;
    ``contexts[k]`` are the strings before their last characters and ``rest[k]`` the weight that is left for the next order.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        size = len(self.langs)
        each = [self._orders(*counts[lang]) for lang in self.langs]
        self.grams = {k: np.unique(np.concatenate([x[k][0] for x in each])) if each else np.zeros(0, np.uint64) for k in range(1, ORDER + 1)}
        self.contexts = {k: np.unique(self.grams[k] >> np.uint64(CHAR)) for k in range(2, ORDER + 1)}
        self.seen = {k: np.zeros((len(g), size), np.float32) for k, g in self.grams.items()}
        self.rest = {k: np.ones((len(c), size), np.float32) for k, c in self.contexts.items()}
        self.new = np.ones(size)  # of a character that no language has
        for i, orders in enumerate(each):
            self._learn(i, orders)
        self.logs = np.concatenate([np.log(self.probabilities(self.grams[ORDER][a:a + 100_000])).astype(np.float32) for a in range(0, len(self.grams[ORDER]), 100_000)] or [np.zeros((0, size), np.float32)])

    @staticmethod
    def _orders(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Keys and counts by order; a lower order counts before how many characters a string was seen."""
        out = {ORDER: (keys, counts)}
        for k in range(ORDER - 1, 0, -1):
            out[k] = np.unique(_suffix(out[k + 1][0], k), return_counts=True)
        return out

    def _learn(self, i: int, orders: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        letters, n = orders[1]
        whole = n.sum() + 0.5 * (len(self.grams[1]) + 1)
        self.seen[1][:, i] = 0.5 / whole
        self.seen[1][np.searchsorted(self.grams[1], letters), i] = (n + 0.5) / whole
        self.new[i] = 0.5 / whole
        for k in range(2, ORDER + 1):
            keys, n = orders[k]
            d = self._discount(n)
            context, at, kinds = np.unique(keys >> np.uint64(CHAR), return_inverse=True, return_counts=True)
            total = np.bincount(at, n)
            self.seen[k][np.searchsorted(self.grams[k], keys), i] = np.maximum(n - d, 0) / total[at]
            self.rest[k][np.searchsorted(self.contexts[k], context), i] = d * kinds / total

    @staticmethod
    def _discount(counts: np.ndarray) -> float:
        one, two = int((counts == 1).sum()), int((counts == 2).sum())
        return one / (one + 2 * two) if one and two else 0.5

    def probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last character of each key after the others, by language."""
        at, there = _found(self.grams[order], keys)
        if order == 1:
            return np.where(there[:, None], self.seen[1][at], self.new) if len(self.grams[1]) else np.tile(self.new, (len(keys), 1))
        out = self.probabilities(_suffix(keys, order - 1), order - 1)
        left, known = _found(self.contexts[order], keys >> np.uint64(CHAR))
        out[known] *= self.rest[order][left[known]]
        out[there] += self.seen[order][at[there]]
        return out

    def entropies(self, keys: np.ndarray) -> np.ndarray:
        """Cross-entropy per character under each language."""
        at, known = _found(self.grams[ORDER], keys)
        total = self.logs[at[known]].sum(0, dtype=np.float64)
        if not known.all():
            total += np.log(self.probabilities(keys[~known])).sum(0)
        return -total / len(keys)


def train(docs: DataFrame) -> KneserNey:
    """The models of all languages of ``docs`` (``text, lang``)."""
    rows = ngram_counts(docs).toPandas()  # the different four-grams of each language
    counts = {}
    for lang, part in rows.groupby("lang"):
        keys = part["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        counts[str(lang)] = (keys[order], part["n"].to_numpy(np.int64)[order])
    return KneserNey(counts)


def entropies(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``doc_id``, the other columns but text, best language, its entropy and the margin to the next."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            best, low, margin = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                keys = keys_of(text.as_py())
                if not len(keys) or not known.langs:
                    best.append(UND)
                    low.append(None)
                    margin.append(None)
                    continue
                h = known.entropies(keys)
                order = np.argsort(h, kind="stable")
                best.append(known.langs[order[0]])
                low.append(float(h[order[0]]))
                margin.append(float(h[order[1]] - h[order[0]]) if len(h) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(best), pa.array(low, pa.float64()), pa.array(margin, pa.float64())], [*keep, "lang_pred", "entropy", "margin"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, entropy double, margin double")


def _logistic(margins: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve through ``n`` times (margin, right), by Newton steps with a small prior."""
    x = np.stack([np.ones(len(margins)), margins], 1)
    w, prior = np.array([0.0, 10.0]), np.array([[1e-2, 0], [0, 1e-4]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior, x.T @ (n * (p - right)) + prior @ (w - [0.0, 10.0]))
        w = w - step
    return float(w[0]), float(max(w[1], 0.0))


def _limits(scored: DataFrame) -> dict[str, float]:
    """By language: the ``REJECT`` quantile of the entropy of all its own documents."""
    own = scored.where("lang = lang_pred AND entropy IS NOT NULL").groupBy("lang_pred")
    return {r["lang_pred"]: r["most"] for r in own.agg(F.percentile_approx("entropy", REJECT, QUANTILE_ACCURACY).alias("most")).collect()}  # one row per language


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, entropy`` of every row of ``docs`` (``doc_id, text, lang``).

    Learned from are the rows with a language whose crc32(doc_id) modulo 5 is not 0.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", fold.alias("fold"))
    learned = rows.where("fold <> 0 AND lang IS NOT NULL AND text IS NOT NULL")
    with arrow_bytes(spark):
        seen = learned.where(F.col("fold") == CALIBRATION_FOLD).select("lang", "text")
        seen = written(entropies(seen, train(learned.where(F.col("fold") != CALIBRATION_FOLD))), "calibration").where("entropy IS NOT NULL")
        scored = written(entropies(rows.select("doc_id", "fold", "lang", "text"), train(learned)), "languages")
    # A row per step of the margin, however many documents there are.
    steps = seen.groupBy(F.round(F.col("margin") / MARGIN_STEP).alias("step"), (F.col("lang") == F.col("lang_pred")).alias("right")).count().toPandas()
    a, b = _logistic(steps["step"].to_numpy(float) * MARGIN_STEP, steps["right"].to_numpy(float), steps["count"].to_numpy(float)) if len(steps) else (0.0, 1.0)
    own = _limits(scored.where("fold <> 0")) | _limits(seen)
    limit = F.lit(None).cast("double")
    for lang, value in own.items():
        limit = F.when(F.col("lang_pred") == lang, F.lit(float(value))).otherwise(limit)
    score = F.when(F.col("entropy").isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("margin")))))
    rejected = F.coalesce(F.col("entropy") > limit, F.col("lang_pred") == UND)
    return scored.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "lang_pred", score.alias("score"), rejected.alias("rejected"), "entropy")
