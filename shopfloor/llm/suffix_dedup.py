"""Removal of long strings that start more than once, by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``width`` bytes that also starts at another place. The
places are the suffixes of all texts; two of them tie if their first ``width`` bytes are equal.

1. Equal texts are reduced to one, with their number; a text that occurs twice goes as a whole,
   and its one copy still stands for all of them against other texts.
2. Cover samples: the offsets of a text whose remainder modulo ``PERIOD`` is in a difference
   cover. Any two suffixes have a common distance below ``PERIOD`` at which both meet a sample,
   so a tie of ``width`` bytes contains, in both, the same sample block of
   ``width - PERIOD + 1`` bytes. The blocks are ranked over the whole corpus (shared or alone)
   before any suffix is sorted. A suffix none of whose samples is shared has no long tie.
3. The other suffixes are sorted by a 96-bit key of their first ``width`` bytes, one bucket of
   the key space at a time: a task holds ``BUCKET_KEYS`` suffixes, and a pass over the text as
   many as take the bytes of the text itself, so memory is bounded and shuffle files never
   exceed the input however much of it repeats. Each bucket answers which of its suffixes tie.

The key is a hash: strings with equal keys count as equal, no byte is compared after it. Its first 61 bits are a
polynomial of the bytes modulo the prime 2**61 - 1 at a point drawn anew by the driver for every run, so two given
different strings of ``width`` bytes agree in them with a probability below ``width`` / 2**60, whatever the strings are
made of; a polynomial modulo 2**64 gives another 32 bits.

The same steps over words in place of bytes tell the texts with a passage of ``words`` consecutive words that also
stands in another text: word offsets take a difference cover of period ``PASSAGE_PERIOD``, and the word suffixes near a shared
sample are sorted by the key of their first words. Here only other texts count, not other places of the same text.

Suffixes travel as packed arrays, one row per piece of text and bucket, after equal keys of a
piece are merged: a string that fills a third of the corpus counts once per piece.

Defined cases: a NULL text is empty; a text shorter than ``width`` stays; a text of fewer than ``words`` words has no passage;
equal texts of two rows are two texts; matches do not cross texts; strings are judged on the input. Rows with the same ``doc_id`` are separate rows. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, drop_folder, let_go, new_folder, text_or_empty, written

PERIOD = 181
PASSAGE_PERIOD = 13  #: period of the cover of word offsets
PASSAGE_WORDS = 50  #: a passage of over 50 words has two such strings, so a word that touches its neighbour outside may differ
PIECE_BYTES = 1 << 20  #: texts are handled in pieces of about this size, at least one text
BUCKET_KEYS = 1 << 20  #: suffixes that one bucket holds on average
BASE = 0x9E3779B97F4A7C15  #: odd multiplier of the rolling keys modulo 2**64


def difference_cover(period: int) -> np.ndarray:
    """A set of residues whose differences give every residue (Colbourn and Ling's construction)."""
    r = 0
    while 24 * r * r + 36 * r + 13 < period:
        r += 1
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return np.unique(np.concatenate([[0], np.cumsum(steps)]) % period)


class RollingKeys:
    """Keys of all strings of one width in a byte array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, seed: int, longest: int) -> None:
        self.values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.power, self.inverse = self._powers(BASE, longest), self._powers(pow(BASE, -1, 2**64), longest)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keys of the strings of values from each start to each end."""
        if len(values) > len(self.power) - 1:
            self.power = self._powers(int(self.power[1]), len(values))
            self.inverse = self._powers(int(self.inverse[1]), len(values))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[:len(values)])])
        key = (sums[ends] - sums[starts]) * self.inverse[starts]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        return key


PRIME = (1 << 61) - 1
NEAR = 1 << 14  #: numbers worked on at a time, which a processor keeps close


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.minimum(x, x - np.uint64(PRIME))  # below the prime the difference wraps to a larger number


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits: no sum below passes 64 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


class PrimeKeys:
    """Keys of all strings of one width, by prefix sums of a polynomial modulo the prime at ``point``."""

    def __init__(self, point: int, longest: int) -> None:
        self.point = point
        self._grow(longest)

    def _grow(self, longest: int) -> None:
        power, self.inverse = self._powers(self.point, longest), self._powers(pow(self.point, -1, PRIME), longest)
        self.halves = power >> np.uint64(31), power & np.uint64((1 << 31) - 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, known = np.ones(n + 1, np.uint64), 1
        while known <= n:
            more = min(known, n + 1 - known)
            out[known:known + more] = _product(out[:more], np.full(more, pow(base, known, PRIME), np.uint64))
            known += more
        return out

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keys of the strings of values (bytes, or any 64-bit numbers) from each start to each end, the 61 bits on the left.

        A byte counts as one more than its value, so that none is zero. The halves of the terms are summed by themselves:
        the sums may wrap, their differences are below 2**64 for strings of up to 2**20 values.
        """
        n = len(values)
        if n > len(self.inverse) - 1:
            self._grow(n)
        left, right = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        for at in range(0, n, NEAR):
            some, high, low = values[at:at + NEAR], *(x[at:min(at + NEAR, n)] for x in self.halves)
            if values.dtype == np.uint8:
                small = some.astype(np.uint64) + np.uint64(1)
                left[at + 1:at + 1 + len(some)], right[at + 1:at + 1 + len(some)] = small * high, small * low
            else:
                terms = _product(_reduced(some), (high << np.uint64(31)) + low)
                left[at + 1:at + 1 + len(some)], right[at + 1:at + 1 + len(some)] = terms >> np.uint64(31), terms & np.uint64((1 << 31) - 1)
        np.cumsum(left, out=left)
        np.cumsum(right, out=right)
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(out), NEAR):
            a, b = starts[at:at + NEAR], ends[at:at + NEAR]
            high, low = left[b] - left[a], right[b] - right[a]
            sums = _reduced((high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + _reduced(low))
            out[at:at + NEAR] = _product(sums, self.inverse[a]) << np.uint64(3)
        return out


_PRIME_KEYS: list[PrimeKeys] = []


def _of_point(point: int) -> PrimeKeys:
    if not _PRIME_KEYS or _PRIME_KEYS[0].point != point:  # those of the last run go
        _PRIME_KEYS[:] = [PrimeKeys(point, 2 * PIECE_BYTES)]
    return _PRIME_KEYS[0]


_KEYS: dict[int, RollingKeys] = {}


def _rolling(seed: int) -> RollingKeys:
    if seed not in _KEYS:
        _KEYS[seed] = RollingKeys(seed, 2 * PIECE_BYTES)
    return _KEYS[seed]


def _keys(seed: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of strings of bytes."""
    rolling = _rolling(seed)
    return rolling.of(rolling.values[data], starts, ends)


_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


def _words(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of every word ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end, and the number of words of each text."""
    space, opens = _SPACES[data], np.zeros(len(data) + 1, bool)
    text_starts = np.cumsum(lengths) - lengths
    opens[text_starts] = True
    opens[-1] = True
    begins, finishes = opens[:-1].copy(), opens[1:].copy()
    begins[1:] |= space[:-1]
    finishes[:-1] |= space[1:]
    starts, ends = np.flatnonzero(begins & ~space), np.flatnonzero(finishes & ~space) + 1
    counts = np.diff(np.append(np.searchsorted(starts, text_starts), len(starts)))
    return _keys(0, data, starts, ends), counts


def _starts(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a string of ``width`` bytes starts at each byte of texts laid end to end, and the byte's offset in its text."""
    ends = np.cumsum(lengths)
    offset = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    return offset + width <= np.repeat(lengths, lengths), offset


_PIECES = "piece string, digests array<binary>, copies array<long>, lengths array<long>, data binary"


def _to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[bytes, int, bytes]] = []

    def close() -> pa.RecordBatch:
        name = hashlib.md5(b"".join(x[0] for x in held)).hexdigest()  # of different texts: no other piece has it
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[x[0] for x in held]], pa.list_(pa.binary())), pa.array([[x[1] for x in held]], pa.list_(pa.int64())), pa.array([[len(x[2]) for x in held]], pa.list_(pa.int64())), pa.array([b"".join(x[2] for x in held)], pa.binary())], ["piece", "digests", "copies", "lengths", "data"])

    size = 0
    for batch in batches:
        for digest, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.append((digest, n, data.as_buffer().to_pybytes()))
            size += len(held[-1][2])
            if size >= PIECE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _unique_keys(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) in ascending order, where each key went, and which occur more than once."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if len(a) and (a[1:] == a[:-1]).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.cumsum(new) - 1
    at = np.empty(len(a), np.int64)
    at[order] = place
    return a[new], b[new], at, np.bincount(place, minlength=int(new.sum())) > 1


_BLOBS = "bucket long, piece string, n long, keys binary"


def _sender(select: Callable, buckets: int, low: int, high: int) -> Callable:
    """Keys of the selected suffixes of each piece in buckets from low to high, a packed array for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _rows(batch):
                _, a, b, _ = select(item)
                here = (a >> np.uint64(40)).astype(np.int64) * buckets >> 24
                here = (here >= low) & (here < high)
                a, b, _, _ = _unique_keys(a[here], b[here])
                if not len(a):
                    continue
                bucket = (a >> np.uint64(40)).astype(np.int64) * buckets >> 24
                cut = np.flatnonzero(np.diff(bucket)) + 1
                lows, highs = np.concatenate([[0], cut]), np.append(cut, len(a))
                piece = item["piece"].as_py()
                blobs = [a[i:j].tobytes() + b[i:j].tobytes() for i, j in zip(lows, highs, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[lows], pa.int64()), pa.array([piece] * len(lows)), pa.array(highs - lows, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "piece", "n", "keys"])

    return run


def _sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket after the other; each piece hears which of its keys another piece has too."""
    bucket, held = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        first = np.concatenate([np.frombuffer(k, "<u8", n) for _, n, k in held])
        second = np.concatenate([np.frombuffer(k, "<u4", n, 8 * n) for _, n, k in held])
        _, _, at, many = _unique_keys(first, second)
        shared, low = many[at], 0
        names, bits = [], []
        for piece, n, _ in held:
            if shared[low:low + n].any():
                names.append(piece)
                bits.append(np.packbits(shared[low:low + n]).tobytes())
            low += n
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([bucket] * len(names), pa.int64()), pa.array(bits, pa.binary())], ["piece", "bucket", "bits"])

    for batch in batches:
        for i, piece, n, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if i != bucket and held:
                yield from answer()
                held = []
            bucket = i
            held.append((piece, n, keys.as_buffer().to_pybytes()))
    if held:
        yield from answer()


def _shared(select: Callable, item: dict, answers: list | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The selected places of a piece, and for each whether its string starts elsewhere too."""
    places, first, second, texts = select(item)
    a, _, at, many = _unique_keys(first, second)
    if texts is not None:  # of the same text don't count: the first and last text of each key differ
        low, high = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        low[at[::-1]] = texts[::-1]
        high[at] = texts
        many = low != high
    bucket = (a >> np.uint64(40)).astype(np.int64) * buckets >> 24
    for x in answers or []:
        low, high = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
        many[low:high] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=high - low).astype(bool)
    return places, many[at]


def _ranked(pieces: DataFrame, select: Callable, total: int, passes: int, name: str) -> tuple[DataFrame, int]:
    """Answers (piece, list of bucket and bits) for the selected suffixes of all pieces."""
    spark = pieces.sparkSession
    buckets = max(passes, min(1 << 24, -(-total // BUCKET_KEYS)))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = []
    for k in range(passes):
        low, high = buckets * k // passes, buckets * (k + 1) // passes
        blobs = pieces.mapInArrow(_sender(select, buckets, low, high), _BLOBS).repartition(max(high - low, least), "bucket")
        done.append(written(blobs.sortWithinPartitions("bucket").mapInArrow(_sorter, "piece string, bucket long, bits binary"), name))
        let_go(spark)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy("piece").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), buckets  # a bit per suffix of a piece


def _laid(item: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(item["data"].as_buffer(), np.uint8), np.array(item["lengths"].as_py(), np.int64)


def _bits(item: dict, name: str, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(item[name].as_buffer(), np.uint8), count=n))


def _cover_places(lengths: np.ndarray, block: int, period: int) -> np.ndarray:
    """The places of texts laid end to end at which a sample block starts."""
    fits, offset = _starts(lengths, block)
    residue = np.zeros(period, bool)
    residue[difference_cover(period)] = True
    return np.flatnonzero(fits & residue[offset % period])


# A selection gives places of a piece, two parts of the key of the string there and, where only other texts count, the text.


def _sampled(width: int) -> Callable:
    def select(item: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, None]:
        data, lengths = _laid(item)
        block = width - PERIOD + 1
        places = _cover_places(lengths, block, PERIOD)
        return places, _keys(0, data, places, places + block), np.zeros(len(places), np.uint32), None  # a false tie here only adds a suffix to sort

    return select


def _candidates(width: int, point: int) -> Callable:
    def select(item: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, None]:
        data, _ = _laid(item)
        places = _bits(item, "marked", len(data))
        if not len(places):
            return places, np.zeros(0, np.uint64), np.zeros(0, np.uint32), None
        return places, _of_point(point).of(data, places, places + width), (_keys(0, data, places, places + width) >> np.uint64(32)).astype(np.uint32), None

    return select


def _texts_of(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.cumsum(lengths), places, "right")


def _sampled_words(words: int) -> Callable:
    def select(item: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        values, counts = _words(*_laid(item))
        block = words - PASSAGE_PERIOD + 1
        places = _cover_places(counts, block, PASSAGE_PERIOD)
        return places, _rolling(0).of(values, places, places + block), np.zeros(len(places), np.uint32), _texts_of(places, counts)

    return select


def _candidate_words(words: int, point: int) -> Callable:
    def select(item: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not item["n_words"].as_py():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        values, counts = _words(*_laid(item))
        places = _bits(item, "marked_words", len(values))
        second = _rolling(0).of(values, places, places + words)
        return places, _of_point(point).of(values, places, places + words), (second >> np.uint64(32)).astype(np.uint32), _texts_of(places, counts)

    return select


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for row in range(batch.num_rows):
        yield {k: batch.column(i)[row] for i, k in enumerate(batch.schema.names)}


_MARKED = f"{_PIECES}, marked binary, n long, marked_words binary, n_words long"


def _near_shared(places: np.ndarray, shared: np.ndarray, lengths: np.ndarray, width: int, period: int) -> np.ndarray:
    """The suffixes of ``width`` or more with a shared sample within a period."""
    fits, _ = _starts(lengths, width)
    change = np.zeros(len(fits) + 1, np.int32)  # a shared sample marks the suffixes up to a period before it
    hit = places[shared]
    np.add.at(change, np.maximum(hit - period + 1, 0), 1)
    np.add.at(change, hit + 1, -1)
    return (np.cumsum(change[:-1]) > 0) & fits


def _mark(width: int, buckets: int, words: int, word_buckets: int) -> Callable:
    """Pieces with the suffixes left to be sorted, of bytes and of words."""
    select, select_words = _sampled(width), _sampled_words(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _rows(batch):
                data, lengths = _laid(item)
                marked = _near_shared(*_shared(select, item, item["answers"].as_py(), buckets), lengths, width, PERIOD)
                _, counts = _words(data, lengths)
                marked_words = _near_shared(*_shared(select_words, item, item["word_answers"].as_py(), word_buckets), counts, words, PASSAGE_PERIOD)
                kept = [pa.array([item[k].as_py()], t) for k, t in zip(("piece", "digests", "copies", "lengths", "data"), (pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)]
                found = [x for bits in (marked, marked_words) for x in (pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([int(bits.sum())], pa.int64()))]
                yield pa.RecordBatch.from_arrays(kept + found, ["piece", "digests", "copies", "lengths", "data", "marked", "n", "marked_words", "n_words"])

    return run


def _cut(width: int, buckets: int, words: int, word_buckets: int, point: int) -> Callable:
    """Per text of a piece: what goes, the digest of what stays, and whether another text has a passage of it."""
    select, select_words = _candidates(width, point), _candidate_words(words, point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _rows(batch):
                data, lengths = _laid(item)
                copies = np.array(item["copies"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                places, shared = _shared(select, item, item["answers"].as_py(), buckets)
                change = np.zeros(len(data) + 1, np.int32)
                change[places[shared]] += 1
                change[places[shared] + width] -= 1
                gone = np.cumsum(change[:-1]) > 0
                starts = ends - lengths
                whole = (copies > 1) & (lengths >= width)
                for start, end in zip(starts[whole], ends[whole], strict=True):
                    gone[start:end] = True
                _, counts = _words(data, lengths)
                word_places, elsewhere = _shared(select_words, item, item["word_answers"].as_py(), word_buckets)
                passage = (copies > 1) & (counts >= words)
                passage[_texts_of(word_places[elsewhere], counts)] = True
                out: tuple[list, list, list, list] = ([], [], [], [])
                for start, end in zip(starts, ends, strict=True):
                    own = gone[start:end]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    for to, value in zip(out, (int(own.sum()), len(edges) // 2, hashlib.sha256(data[start:end][~own].tobytes()).hexdigest(), [[int(a), int(b)] for a, b in edges.reshape(-1, 2)]), strict=True):
                        to.append(value)
                yield pa.RecordBatch.from_arrays([item["digests"].values, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], pa.list_(pa.list_(pa.int64()))), pa.array(passage)], ["digest", "n_removed", "n_spans", "kept_sha256", "spans", "repeats_passage"])

    return run


def repeated_strings(docs: DataFrame, width: int = 400, words: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, repeats_passage`` of every row.

    Spans are byte ranges [start, end) of strings of ``width`` bytes; ``repeats_passage`` tells whether ``words`` consecutive
    words of the text also stand in another text.
    """
    if width < 2 * PERIOD or words < 2 * PASSAGE_PERIOD:
        raise ValueError(f"the width is {2 * PERIOD} bytes or more, a passage has {2 * PASSAGE_PERIOD} words or more")
    spark, point = docs.sparkSession, secrets.randbelow(PRIME - 2) + 2  # a retried task has the same point
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    keyed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    with arrow_bytes(spark):
        rows = written(keyed.select("doc_id", "digest", "n_bytes"), "digests")
        long_enough = keyed.where(F.col("n_bytes") >= min(width, 2 * words - 1))
        distinct = long_enough.groupBy("digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        pieces = written(distinct.select("digest", "copies", "text").mapInArrow(_to_pieces, _PIECES), "pieces")
        let_go(spark)
        n_bytes = pieces.select(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
        samples, n = _ranked(pieces, _sampled(width), n_bytes * len(difference_cover(PERIOD)) // PERIOD, 1, "sample-ranks")
        word_samples, n_word = _ranked(pieces, _sampled_words(words), n_bytes * len(difference_cover(PASSAGE_PERIOD)) // (5 * PASSAGE_PERIOD), 1, "word-sample-ranks")
        joined = pieces.join(samples, "piece", "left").join(word_samples.withColumnRenamed("answers", "word_answers"), "piece", "left")
        path = new_folder(spark, "marked")
        joined.mapInArrow(_mark(width, n, words, n_word), _MARKED).write.option("compression", "zstd").parquet(path)
        marked = spark.read.schema(_MARKED).parquet(path)
        let_go(spark)
        total, total_words = (x or 0 for x in marked.agg(F.sum("n"), F.sum("n_words")).first())
        answers, n = _ranked(marked, _candidates(width, point), total, max(1, -(-12 * total // max(1, n_bytes))), "suffix-ties")
        let_go(spark)
        word_answers, n_word = _ranked(marked, _candidate_words(words, point), total_words, max(1, -(-12 * total_words // max(1, n_bytes))), "passage-ties")
        let_go(spark)
        joined = marked.join(answers, "piece", "left").join(word_answers.withColumnRenamed("answers", "word_answers"), "piece", "left")
        cut = written(joined.mapInArrow(_cut(width, n, words, n_word, point), "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, repeats_passage boolean"), "cut")
        drop_folder(spark, path)
        let_go(spark)
    per_text = rows.join(cut, "digest", "left")
    # A text without a repeated string keeps the digest of all of it.
    return per_text.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"),
        F.coalesce("repeats_passage", F.lit(False)).alias("repeats_passage"))
