r"""Benchmark decontamination by template windows.

Texts are read as words (letters and digits, a number with its separators, decimals and sign, or
one currency or per cent sign), compared in lower case. Numbers, names and units are replaced by
placeholders of their type; what was replaced is the slot value. A number is a word with a digit, a
unit is a word of ``UNITS`` right after a number, and a name is a run of words written with a
capital. A capital at the start of a sentence may be a name or not, so texts have two readings,
one for each; a third, of the plain words, finds copies whatever their capitals.

Windows of ``WINDOW`` words are hashed; documents and benchmark items meet on equal windows. Of a
template only windows with at least ``LITERALS`` literal words are looked up (items shorter than a
window are one window); of the plain words all are. An item without such a template window is looked
up by its window with the most literal words and must agree as a whole, if it has ``SPECIFIC``
literal words at least and they are half of it or it is as long as a window; a template that says
less than that would be met everywhere, so there only the plain words count, slot values included.

A hit is then checked in full, word by word from the window on in both directions. Where words
differ, the walk goes on after up to ``GAP`` words on either side if the next ``AGREE`` words agree,
so a slot of another form does not end it; plain words get no such gap. Walks on alignments that
differ by ``WINDOW`` words at most are taken together. The windows walked over
must be at least ``COVER`` of all windows of the item, and the slots must be consistent: equal item
values always stand against equal document values. So an item with other numbers or names is
caught, while a text that only shares the template with clashing values is not.

The benchmark is broadcast in blocks of ``BLOCK_WINDOWS`` windows; the documents are read once per
block (one block for any benchmark up to that size) and nothing is shuffled but the hits.

Defined cases: a NULL or empty text has no window and is clean; a NULL item, or one without a word, is
skipped; items with equal texts are all reported; repeated rows are judged alike; an empty benchmark
leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, free_names, text_or_empty, written

WINDOW = 8
LITERALS = 4
COVER = 0.5
SPECIFIC = 3  #: literal words of an item that is looked up as a whole
GAP, AGREE = 4, 3  #: words that a walk may skip on either side, and that must agree after them
BLOCK_WINDOWS = 1_000_000
GROUP_WORDS = 200_000  #: words of documents that are looked up at a time
KNOWN_PIECES = 400_000  #: a worker forgets its pieces once it knows more, before the next texts
KNOWN_KEYS = 100_000  #: words whose keys a worker remembers beside its pieces

#: Words that count as a unit after a number.
UNITS = frozenset("""
    % percent mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram
    kilograms ton tons tonnes oz ounce ounces lb lbs pound pounds ml l litre litres liter liters gallon gallons s sec second
    seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph w kw kwh v a hz
    khz mhz ghz j kj cal kcal n pa k c f usd eur gbp dollar dollars cent cents euro euros $ € £ °
""".split())

_NUMBERED = r"(?:(?<=\d)[.,'’\u00a0\u202f\u2009]\d[^\W_]*)*"  #: the rest of a number after its first separator
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\W_])"  #: most words, found sooner than by the general pattern after it
_PIECES = re.compile(rf"{_WORD}|[^\W_]+{_NUMBERED}|[-+−](?<![^\W_)\]][-+−])\d[^\W_]*{_NUMBERED}|[%$€£°]|[.!?:;\n]|[,()\[\]\"“”/|]").findall
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.uint64(0x5851F42D4C957F2D)  #: tells windows of plain words from those of templates
_THOUSANDS = re.compile(r"[-+−]?\d{1,3}(?:[,'’\u00a0\u202f\u2009]\d{3})+(?:\.\d+)?").fullmatch
_SEPARATORS = re.compile(r"[,'’\u00a0\u202f\u2009]")


class WordKeys(dict):
    """64-bit keys of words, remembered."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= KNOWN_KEYS:
            self.clear()
        self[word] = key = xxh64_intdigest(word.encode("utf-8", "replace"), 7)
        return key


_STOPS = frozenset(".!?:;\n")
_BREAKS = frozenset(",()[]\"\u201c\u201d/|")
_LITERAL, _NUMBER, _UNIT, _CAPITAL, _STOP, _BREAK, _BORDER = range(7)
_BORDERS = "\0"  #: stands between two documents
READINGS = ("plain", "literal", "name")  #: nothing replaced; the first words of sentences are literal; they are names if capital


def _kind(word: str) -> tuple[int, bool]:
    """The kind of a piece, and whether it may be a name."""
    if word == _BORDERS:
        return _BORDER, False
    if word in _STOPS:
        return _STOP, False
    if word in _BREAKS:
        return _BREAK, False
    if any(ch.isdigit() for ch in word):
        return _NUMBER, False
    capital = word[0].isupper() and not word.isupper()
    return (_UNIT if word.lower() in UNITS else _CAPITAL if capital else _LITERAL), capital


def _plain(word: str, kind: int) -> str:
    """A word as it is compared: in lower case, and a number without the separators of thousands."""
    return _SEPARATORS.sub("", word) if kind == _NUMBER and _THOUSANDS(word) else word.lower()


class _Looks(dict):
    """The kind of words, whether they may be names, and how they are compared, remembered."""

    def __missing__(self, word: str) -> tuple[int, bool, str]:
        if len(self) > 200_000:
            self.clear()
        kind, capital = _kind(word)
        self[word] = look = (kind, capital, _plain(word, kind))
        return look


_LOOKS = _Looks()


def template(text: str, reading: str = "literal") -> tuple[list[str], list[str | None]]:
    """The words of a text in one of ``READINGS`` with placeholders, and the slot values (None for literal words)."""
    words: list[str] = []
    values: list[str | None] = []
    start, joined, after_number = True, False, False
    for kind, capital, value in map(_LOOKS.__getitem__, _PIECES(text)):
        if kind in (_STOP, _BREAK):
            start, joined = start or kind == _STOP, False
            continue
        if reading == "plain":
            words.append(value)
            values.append(None)
            continue
        name = False
        if kind == _NUMBER:
            words.append("<number>")
        elif kind == _UNIT and after_number:
            words.append("<unit>")
        elif capital and (reading == "name" or not start):
            name = True
            if joined:
                values[-1] = f"{values[-1]} {value}"
            else:
                words.append("<name>")
        else:
            words.append(value)
        if len(words) > len(values):
            values.append(value if words[-1][0] == "<" else None)
        start, joined, after_number = False, name, kind == _NUMBER
    return words, values


class Pieces(dict):
    """Words and sentence ends under numbers, with what :func:`template` makes of them in arrays."""

    def __init__(self, keys: WordKeys) -> None:
        self.keys_of = keys
        self.kind, self.capital, self.key = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, bool), np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.kind):
            self.kind, self.capital, self.key = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.capital, self.key))
        kind, self.capital[at] = _kind(word)
        self.kind[at] = kind
        self.key[at] = self.keys_of[_plain(word, kind)]
        self[word] = at
        return at

    def found(self, text: str) -> np.ndarray:
        """The numbers of the pieces of a text."""
        found = _PIECES(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def template_keys(self, texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """By reading: the keys of the template words of all ``texts``, and the place of the border before each text."""
        if len(self) > KNOWN_PIECES:
            self.clear()
        border = np.array([self[_BORDERS]])
        at = np.concatenate([x for text in texts for x in (border, self.found(text))] + [border])
        kind = self.kind[at]
        stop, gap = np.cumsum((kind == _STOP) | (kind == _BORDER)), np.cumsum((kind == _STOP) | (kind == _BREAK))
        word = (kind != _STOP) & (kind != _BREAK)
        at, kind, stop, gap = at[word], kind[word], stop[word], gap[word]
        key, capital, is_border = self.key[at], self.capital[at], kind == _BORDER
        before = lambda x: np.concatenate([[False], x[:-1]])
        starts = np.concatenate([[True], stop[1:] != stop[:-1]]) | before(is_border)
        joined = np.concatenate([[False], gap[1:] == gap[:-1]])
        out = {"plain": (key, np.flatnonzero(is_border))}
        number = kind == _NUMBER
        unit = (kind == _UNIT) & before(number)
        typed = np.where(number, np.uint64(self.keys_of["<number>"]), np.where(unit, np.uint64(self.keys_of["<unit>"]), key))
        for reading in READINGS[1:]:
            name = capital & ~unit & (~starts if reading == "literal" else True)
            stays = ~(name & before(name) & joined)
            out[reading] = np.where(name, np.uint64(self.keys_of["<name>"]), typed)[stays], np.flatnonzero(is_border[stays])
        return out


@cache
def _worker_pieces() -> Pieces:
    """The pieces that a worker process has seen, kept from task to task."""
    return Pieces(WordKeys())


def _window_keys(own: np.ndarray, sizes: set[int], plain: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``sizes``: a key for each window of so many words."""
    out = np.zeros(len(own), np.uint64)
    for k in range(min(max(sizes, default=0), len(own))):
        out = out[:len(own) - k] * _MULTIPLIER + own[k:]
        if k + 1 in sizes:
            yield k + 1, (out ^ _PLAIN if plain else out) + np.uint64(k + 1)


def _walk(item: list[str], doc: list[str], i: int, j: int) -> list[tuple[int, int]]:
    """Places that agree from (``i``, ``j``) on, over gaps of at most ``GAP`` words."""
    out = []
    while i < len(item) and j < len(doc):
        if item[i] == doc[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        for a, b in _GAPS:
            ahead = item[i + a:i + a + AGREE]
            if len(ahead) == AGREE and ahead == doc[j + b:j + b + AGREE] and sum(x[0] != "<" for x in ahead) > 1:
                i, j = i + a, j + b
                break
        else:
            break
    return out


_GAPS = sorted(((a, b) for a in range(GAP + 1) for b in range(GAP + 1) if a or b), key=lambda x: (sum(x), x[0] != x[1]))


def _run(item: list[str], doc: list[str], i: int, j: int) -> list[tuple[int, int]]:
    """Places that agree from (``i``, ``j``) on, without a gap."""
    n = 0
    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
        n += 1
    return [(i + k, j + k) for k in range(n)]


class Block:
    """Windows of some benchmark items in their readings, sorted by key."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        keys = WordKeys()
        self.items, self.sizes = [], {True: set(), False: set()}
        found, owner, place = [], [], []
        for item_id, text in items:
            seen = []
            for reading in READINGS:
                words, values = template(text, reading)
                if not words or (reading == "name" and (words, values) == seen[-1]):
                    continue
                seen.append((words, values))
                size, least = min(WINDOW, len(words)), COVER
                ((_, own),) = _window_keys(np.fromiter(map(keys.__getitem__, words), np.uint64, len(words)), {size}, reading == "plain")
                use = np.arange(len(own))
                if reading != "plain":
                    literal = np.cumsum([0, *(v is None for v in values)])
                    inside = literal[size:] - literal[:len(literal) - size]
                    use = np.flatnonzero(inside >= min(LITERALS, size))
                    if not len(use):  # the whole item or nothing
                        if literal[-1] < SPECIFIC or (len(words) < WINDOW and 2 * literal[-1] < len(words)):
                            continue
                        use, least = np.array([inside.argmax()]), 1.0
                self.sizes[reading == "plain"].add(size)
                found.append(own[use])
                owner.append(np.full(len(use), len(self.items), np.int32))
                place.append(use.astype(np.int32))
                self.items.append((item_id, reading == "plain", words, values, size, least))
        self.keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner, self.place = self.keys[order], *(np.concatenate(x)[order] if x else np.zeros(0, np.int32) for x in (owner, place))
        # Most windows of a document are told from all of these by a few bits of their key.
        self.bits = np.uint64(min(24, max(16, len(self.keys).bit_length() + 4)))
        self.known = np.zeros(1 << int(self.bits), bool)
        self.known[self.keys >> (np.uint64(64) - self.bits)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def seeds(self, texts: list[str], pieces: Pieces) -> dict[int, list[tuple[str, int, int]]]:
        """By text: (reading, first word, window of this block) of the windows that are met."""
        met: dict[int, list[tuple[str, int, int]]] = {}
        for reading, (own, borders) in pieces.template_keys(texts).items():
            for _, found in _window_keys(own, self.sizes[reading == "plain"], reading == "plain"):
                hit = np.flatnonzero(self.known[found >> (np.uint64(64) - self.bits)])
                low, high = (np.searchsorted(self.keys, found[hit], side) for side in ("left", "right"))
                some = high > low
                hit, low, high = hit[some], low[some], high[some]
                text = np.searchsorted(borders, hit, "right") - 1
                for d, at, a, b in zip(text.tolist(), (hit - borders[text] - 1).tolist(), low.tolist(), high.tolist(), strict=True):
                    met.setdefault(d, []).extend((reading, at, k) for k in range(a, b))
        return met

    def hits(self, texts: list[str], pieces: Pieces) -> list[list[tuple[int, int]]]:
        """For each text: (item_id, windows that agree) of the items found in it."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if self.items and texts:
            for d, met in self.seeds(texts, pieces).items():
                out[d] = self._checked(texts[d], met)
        return out

    def _checked(self, text: str, met: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        read = {r: template(text, r) for r in {r for r, _, _ in met}}
        back = {r: words[::-1] for r, (words, _) in read.items()}
        walked: set[tuple[str, int, int, int]] = set()
        walks: dict[tuple[str, int], list[list[tuple[int, int]]]] = {}
        for reading, at, k in met:
            owner, place = int(self.owner[k]), int(self.place[k])
            if (reading, owner, place, at) in walked:
                continue
            _, plain, words, _, size, _ = self.items[owner]
            there = read[reading][0]
            if plain != (reading == "plain") or there[at:at + size] != words[place:place + size]:
                continue
            walk = _run if plain else _walk
            before = walk(words[::-1], back[reading], len(words) - place, len(there) - at)
            pairs = [(len(words) - 1 - i, len(there) - 1 - j) for i, j in reversed(before)] + walk(words, there, place, at)
            walked.update((reading, owner, i, j) for i, j in pairs)
            walks.setdefault((reading, owner), []).append(pairs)
        best: dict[int, int] = {}
        for (reading, owner), found in walks.items():
            item_id, _, words, values, size, least = self.items[owner]
            for pairs, windows in _chains(found, size):
                if windows < max(1, least * (len(words) - size + 1)) or (least == 1 and len(pairs) < len(words)):
                    continue
                if consistent([(words[i], values[i], read[reading][1][j]) for i, j in pairs if values[i] is not None]):
                    best[item_id] = max(best.get(item_id, 0), windows)
        return sorted(best.items())


def _chains(walks: list[list[tuple[int, int]]], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Walks on neighbouring alignments one after the other, and the windows that they go over."""
    out: list[tuple[list[tuple[int, int]], int]] = []
    last: dict[int, int] = {}  # by shift: the last chain that ends on it
    for pairs in sorted(walks, key=lambda x: x[0][::-1]):
        (i, j), windows = pairs[0], pairs[-1][0] - pairs[0][0] + 2 - size
        near = [c for d in range(-WINDOW, WINDOW + 1) if (c := last.get(j - i + d)) is not None and out[c][0][-1][0] < i and out[c][0][-1][1] < j]
        if near:
            c = max(near, key=lambda c: out[c][1])
            out[c] = out[c][0] + pairs, out[c][1] + windows
        else:
            c = len(out)
            out.append((pairs, windows))
        last[pairs[-1][1] - pairs[-1][0]] = c
    return out


def consistent(slots: list[tuple[str, str, str]]) -> bool:
    """Whether (type, item value, document value) has one document value for each item value of a type."""
    there: dict[tuple[str, str], str] = {}
    return all(there.setdefault((kind, a), b) == b for kind, a, b in slots)


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read row by row."""
    held, windows = [], 0
    for row in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((row["item_id"], row["text"]))
        windows += row["text"].count(" ") + 1
        if windows >= BLOCK_WINDOWS:
            yield Block(held)
            held, windows = [], 0
    if held:
        yield Block(held)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``hits``: array of (item_id, n_windows) of the benchmark items found.

    Rows are told apart by a number of their own, whatever they repeat; a column ``hits`` of ``docs`` is replaced.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("text", "hits")]
    blocks = _blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.select(*others).withColumn("hits", F.array().cast("array<struct<item_id:long,n_windows:long>>"))
    row = free_names(docs, "_row")[0]
    numbered = docs.select(*others, "text", F.monotonically_increasing_id().alias(row))
    if second is not None:  # read once for each block, so the numbers are written
        numbered = written(numbered, "numbered")
    keep = [*others, row] if second is None else [row]
    kinds = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in keep)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_windows", pa.int64())]))

    def scan(block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = _worker_pieces()
            for batch in batches:
                hits, texts, size = [], [], 0
                for x in batch.column(len(keep)):
                    texts.append(x.as_py())
                    size += len(texts[-1])
                    if size >= 6 * GROUP_WORDS:
                        hits += shared.value.hits(texts, keys)
                        texts, size = [], 0
                hits = [[{"item_id": i, "n_windows": n} for i, n in x] for x in hits + shared.value.hits(texts, keys)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(hits, kind)], [*keep, "hits"])

        rows = numbered.select(*keep, text_or_empty().alias("text"))
        return rows.mapInArrow(run, f"{kinds}, hits array<struct<item_id:long,n_windows:long>>")

    with arrow_bytes(spark):
        if second is None:
            return written(scan(first), "hits").drop(row)
        found = [written(scan(block).where("size(hits) > 0"), "hits") for block in itertools.chain((first, second), blocks)]
    per_row = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.flatten(F.collect_list("hits")).alias("hits"))  # a row per block and document
    none = F.array().cast("array<struct<item_id:long,n_windows:long>>")
    return numbered.drop("text").join(per_row, row, "left").select(*others, F.coalesce("hits", none).alias("hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    key = F.xxhash64(text_or_empty())
    i, k = free_names(docs, "_id", "_key")
    found = contaminated(docs.select("doc_id", key.alias(k), "text"), benchmark)
    out = found.where(F.size("hits") > 0).select(F.col("doc_id").alias(i), k).distinct()
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col(i)) & (key == F.col(k)), "left_anti")
