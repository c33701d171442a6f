"""Toxicity by a weighted finite-state grammar over clauses.

Four small transducers read a clause word by word. The lexicon maps a word to a class, with a
weight: insults are learned, threats, targets (you, they), negations and words of reported speech
are short fixed lists in the languages of the corpus. The scope transducers carry a class over the words after it: a
negation ``NEGATED`` words, a target ``TARGETED`` words, reported speech to the end of the clause,
and quotation marks until they close. Their composition is one table of states; an insult or
threat makes it emit a match of the kind (insult or threat, targeted, negated, reported). A clause
scores, for each kind, the sum of the weights of its matches; what a kind is worth is learned.

1. Lexicon. Words, and beginnings of words of 4 to 6 letters, are counted by text over the labelled
   rows of the learned folds but the last; equal texts of different ids count once. The labels used are
   a hash sample of ``LABEL_ROWS`` at most, which is what may be broadcast: no text is shuffled. The weight of a term is the log
   ratio of its share among toxic and other texts, with half a text added to each; terms
   in ``LEAST_TEXTS`` toxic texts or more with a weight of ``LEAST_WEIGHT`` or more are kept,
   the ``LEXICON`` with most evidence at most (that bounds what is broadcast).
2. Calibration. A logistic regression over a document's matches is fitted on the last learned fold,
   whose rows the lexicon has not seen, by Newton steps; each step is a sum over all its rows.

Defined cases: a NULL or empty text has no match and the score of such a text; several labels of
one document count as the greatest, a NULL label is no label; rows without a ``doc_id`` are not
held out and not learned from; without labels of both kinds every score is the smoothed share of
toxic labels; equal texts score alike; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, text_or_empty, written

FOLDS = 5
BEGINNINGS = (4, 5, 6)
LEAST_TEXTS = 5
LEAST_WEIGHT = 2.3  #: ten times as frequent in toxic texts
LEXICON = 20_000
LABEL_ROWS = 400_000
TERMS_HELD = 200_000  #: terms that a task counts before it passes them on
NEGATED, TARGETED = 3, 4
STEPS, RIDGE = 12, 1.0

# Word lists of the closed classes.
THREATS = ("kill", "hurt", "beat", "burn", "destroy", "stab", "shoot", "umbringen", "töten", "schlagen", "tuer", "frapper", "brûler", "matar", "golpear", "quemar")
TARGETS = ("you", "your", "u", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "te", "toi", "vous", "ils", "elles", "tú", "usted", "ustedes", "ellos", "ellas")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás", "ni")
REPORTS = ("said", "says", "say", "told", "wrote", "called", "quoted", "sagte", "sagt", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
KINDS = 16  #: insult or threat, targeted or not, negated or not, reported or not
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]|[\"“”«»]")
_CLAUSE_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")


def counter(words: int, by: int) -> dict[tuple[int, int], int]:
    """A transducer that is on for some words after a class: (state, class) to state."""
    return {(s, c): words if c == by else max(0, s - 1) for s in range(words + 1) for c in range(7)}


def switch(on: int, toggle: int) -> dict[tuple[int, int], int]:
    """A transducer for reported speech: 1 after a word of it, 2 between quotation marks."""
    return {(s, c): (0 if s == 2 else 2) if c == toggle else 1 if c == on and s == 0 else s for s in range(3) for c in range(7)}


@lru_cache
def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composition: next state and emitted kind (-1 for none), by state and class. State 0 starts a text."""
    targeted, negated, reported = counter(TARGETED, TARGET), counter(NEGATED, NEGATION), switch(REPORT, QUOTE)
    states = [(t, n, r) for t in range(TARGETED + 1) for n in range(NEGATED + 1) for r in range(3)]
    number = {s: i for i, s in enumerate(states)}
    follow, emit = [], []
    for t, n, r in states:
        follow.append([number[targeted[t, c], negated[n, c], reported[r, c]] for c in range(7)])
        kind = (t > 0) * 2 + (n > 0) * 4 + (r > 0) * 8
        emit.append([kind if c == INSULT else kind + 1 if c == THREAT else -1 for c in range(7)])
    return follow, emit


@lru_cache
def after_clause() -> list[int]:
    """The state at the start of the next clause: only an open quotation goes on."""
    n = (TARGETED + 1) * (NEGATED + 1) * 3
    return [2 if s % 3 == 2 else 0 for s in range(n)]


class Lexicon(dict):
    """Class and weight of a word, remembered; learned terms are words or ``^`` and their beginnings."""

    def __init__(self, terms: dict[str, float]) -> None:
        super().__init__()
        self.terms = terms
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in words:
                self[w] = (kind, 1.0)
        self.fixed = dict(self)

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = max((self.terms[t] for t in terms_of(word) if t in self.terms), default=0.0)
        if len(self) > 1_000_000:
            self.clear()
            self.update(self.fixed)
        self[word] = found = (INSULT, weight) if weight else (OTHER, 0.0)
        return found


def terms_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str) -> set[str]:
    return {w for w in _TOKENS.findall(text.lower()) if w[0].isalpha()}


def clauses(text: str, lexicon: Lexicon) -> list[tuple[int, int, list[tuple[int, float]]]]:
    """(start, end, matches) of every clause with a match, a match being (kind, weight); places in code points of the text in lower case."""
    follow, emit, fresh = *grammar(), after_clause()
    text = text.lower()
    out, state, low, matches = [], 0, 0, []
    for m in _TOKENS.finditer(text):
        w = m.group()
        if w in _CLAUSE_ENDS:
            if matches:
                out.append((low, m.end(), matches))
            state, low, matches = fresh[state], m.end(), []
            continue
        kind, weight = (QUOTE, 0.0) if w in _QUOTES else lexicon[w]
        if emit[state][kind] >= 0:
            matches.append((emit[state][kind], weight))
        state = follow[state][kind]
    if matches:
        out.append((low, len(text), matches))
    return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Per kind the log of one plus the summed scores of the clauses, and the greatest clause."""
    sums, best = [0.0] * KINDS, 0.0
    if any(lexicon[w][0] in (INSULT, THREAT) for w in words_of(text)):
        for _, _, matches in clauses(text, lexicon):
            for kind, weight in matches:
                sums[kind] += weight
            best = max(best, sum(weight for kind, weight in matches if kind < 8))
    return [*np.log1p(sums).tolist(), float(np.log1p(best))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts hold each term, summed in the task."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(held[0] | held[1])
        batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([held[1][x] for x in names], pa.int64()), pa.array([held[0][x] for x in names], pa.int64())], ["term", "toxic", "other"])
        for x in held:
            x.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held[toxic].update({t for w in words_of(text.as_py()) for t in terms_of(w)})
            if len(held[0]) + len(held[1]) > TERMS_HELD:
                yield out()
    if held[0] or held[1]:
        yield out()


def learned_terms(rows: DataFrame) -> DataFrame:
    """``term, weight, toxic, other`` from ``doc_id, text, toxic`` (0 or 1, ``LABEL_ROWS`` ids at most), at most ``LEXICON`` terms."""
    # Equal texts count once, with the greatest label: the smallest id stands for them, so only digests are shuffled.
    digest = F.sha2("text", 256)
    chosen = rows.groupBy(digest.alias("digest")).agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    chosen = F.broadcast(written(chosen, "labelled-texts"))
    once = rows.drop("toxic").withColumn("digest", digest).join(chosen, ["doc_id", "digest"]).select("text", "toxic")
    n = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    counts = once.mapInArrow(_counts, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    weight = F.log((F.col("toxic") + 0.5) / (n["t"] + 1.0)) - F.log((F.col("other") + 0.5) / (n["n"] - n["t"] + 1.0))
    kept = counts.where(F.col("toxic") >= LEAST_TEXTS).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    return kept.orderBy((F.col("weight") * F.col("toxic")).desc(), "term").limit(LEXICON)


def matched(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    """The columns of ``rows`` but ``text`` with the ``features`` of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)  # LEXICON terms at most
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            found = [features(x.as_py(), lexicon) for x in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def fitted(rows: DataFrame) -> np.ndarray:
    """Logistic regression of ``toxic`` on ``features`` (the last number is the constant): Newton steps, each a sum over all rows."""
    n = KINDS + 2
    model = np.zeros(n)

    def sums(model: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, bend = np.zeros(n), np.zeros((n, n))
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([np.array(batch.column(0).to_pylist()), np.ones(batch.num_rows)])
                    p = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
                    slope += x.T @ (np.array(batch.column(1).to_pylist()) - p)
                    bend += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([slope, bend.ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"])

        return run

    ridge = np.full(n, RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        parts = rows.select("features", "toxic").mapInArrow(sums(model), "sums array<double>").collect()  # n + n * n numbers a task
        total = np.sum([p["sums"] for p in parts], axis=0)
        step = np.linalg.solve(total[n:].reshape(n, n) + np.diag(ridge), total[:n] - ridge * model)
        model = model + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return model


def labelled(labels: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """``doc_id, toxic`` of the labelled ids outside the held-out fold, a hash sample of ``label_rows`` at most."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("int").alias("toxic"))
    known = written(known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0), "labels")
    n = known.count()
    if n > label_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) < int(0.9 * label_rows / n * (1 << 30))).limit(label_rows)
    return known


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, given ``labels`` (``doc_id, toxic``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labelled(labels)
    last = FOLDS - 1
    with arrow_bytes(docs.sparkSession):
        learned = rows.join(F.broadcast(known.where(fold != last)), "doc_id")
        terms = {r["term"]: r["weight"] for r in learned_terms(learned).collect()}  # LEXICON at most
        found = written(matched(rows, terms), "matches")
    both = found.join(F.broadcast(known.where(fold == last)), "doc_id").select("features", "toxic")
    both = written(both, "calibration")
    n = both.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if 0 < n["t"] < n["n"]:
        model = fitted(both)
    else:
        share = known.agg((F.coalesce(F.sum("toxic"), F.lit(0)) + 0.5) / (F.count("*") + 2.0)).first()[0]
        model = np.append(np.zeros(KINDS + 1), np.log(share / (1 - share)))
    inner = F.lit(float(model[-1]))
    for i, x in enumerate(model[:-1]):
        inner = inner + F.col("features")[i] * float(x)
    score = 1 / (1 + F.exp(-inner))
    held = F.coalesce(fold == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
