"""Token ids as length-limited canonical Huffman codes in independent blocks.

The ids of every text are counted over the whole corpus, the counts give one canonical
code of at most ``max_bits`` bits (package-merge), and each range of ``doc_id`` is written
as a sequence of blocks of whole documents. A block carries its bit stream and the bit
offset of every ``STEP``-th symbol, so a reader decodes all checkpoints of a block side by
side with one table lookup per symbol, and any block without the others.

File format (Parquet folders under one path):

* ``code``: ``id, bits`` - the code lengths, canonical order is (bits, id).
* ``blocks``: ``shard, block, doc_ids, lengths, n_symbols, offsets, payload`` - documents in
  ascending ``doc_id`` order within a shard, shards in ascending order; ``offsets`` are
  little-endian uint32 bit offsets, ``payload`` is the bit stream, most significant bit first.

Defined cases: a NULL text is the empty text, which is the end id alone; a NULL ``doc_id``
sorts first; rows with one ``doc_id`` are written next to each other, ordered by their ids;
an empty table gives an empty file. Extra columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_bytes, drop_folder, new_folder, parts, text_or_empty, written

STEP = 64  #: symbols between two bit-offset checkpoints
BLOCK_SYMBOLS = 1 << 16  #: a block is closed once it holds this many symbols
MAX_BITS = 18  #: longest code word: bounds the decoding table to 2**18 entries
SHARD_TOKENS = 4_000_000  #: symbols of one shard, and so of one task
TEXTS = 1024  #: texts that are encoded at a time
CACHE_WORDS = 300_000  #: a worker forgets words and chunks once it remembers the ids of more, before the next texts

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The vocabulary's own splitting pattern, written out for texts of ASCII and Latin-1 letters only.
_FAST = (rf" ?[{_LETTER}]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?[^ \t\n\r0-9{_LETTER}]++"
         r"|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_ODD = rf"[^\t\n\r -~{_LETTER}]"


class _Ids(dict):
    """Ids of words as little-endian numbers, by the library's own model on first sight."""

    def __init__(self, library: object, kind: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.kind = library.model, {"<u2": "H", "<u4": "I"}[kind]
        assert array(self.kind).itemsize == int(kind[2]) and sys.byteorder == "little"
        plain = {b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173}
        assert {chr(b) for b in plain} < set(ByteLevel.alphabet())
        rest = iter(range(256, 512))  # bytes without a printable form stand for these, in ascending order
        self.shown = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}

    def of(self, word: str) -> bytes:
        shown = word.encode("utf-8").decode("latin-1").translate(self.shown)
        return array(self.kind, [x.id for x in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.of(word)
        return ids


class _Chunks(dict):
    """Ids of a space and what stands up to the next one; ids of chunks of one word are kept here only."""

    def __init__(self, words: _Ids, split: Callable[[str], list[str]]) -> None:
        self.words, self.split = words, split

    def __missing__(self, chunk: str) -> bytes:
        parts = self.split(f" {chunk}")
        self[chunk] = ids = b"".join(map(self.words.__getitem__, parts)) if len(parts) > 1 else self.words.of(parts[0])
        return ids


class TextEncoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    The pattern that such a vocabulary splits texts by yields words whose ids do not depend
    on their neighbours, so the library's model encodes every distinct word once and its ids
    are looked up after that. No word goes on over a space, and a space that something else than
    white space follows begins a word, so a text without other spaces is looked up by the chunks between
    them. The store of words is emptied when it is full. A text that holds an
    added token of the vocabulary, such as an end mark, is encoded by the library as a whole.
    """

    def __init__(self, path: str, kind: str) -> None:
        import re

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added_tokens = added
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.kind = kind
        self.fast, self.odd = re.compile(_FAST).findall, re.compile(_ODD).search
        self.full = regex.compile(public_tokenizers.PATTERN).findall
        self.wide = re.compile(r" (?:[ \t\n\r]|\Z)").search
        self.ids = _Ids(self.library, kind)
        self.chunks = _Chunks(self.ids, self.fast)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of this encoder's kind."""
        if len(self.ids) + len(self.chunks) > CACHE_WORDS:
            self.ids.clear()
            self.chunks.clear()
        if self.added(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.odd(text):
            return b"".join(map(self.ids.__getitem__, self.full(text)))
        if self.wide(text):
            return b"".join(map(self.ids.__getitem__, self.fast(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.ids.__getitem__, self.fast(first))) + b"".join(map(self.chunks.__getitem__, rest))

    def encode_all(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of every text, as by :meth:`encode`, with ``end`` after them.

        The different chunks of all ``texts`` are split into words at once, and only their words are remembered.
        A text with an added token, or with white space after a space or a space at its end, goes through :meth:`encode`.
        """
        if not len(texts):
            return pa.array([], pa.binary())
        if len(self.ids) + len(self.chunks) > CACHE_WORDS:
            self.ids.clear()
            self.chunks.clear()
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        bounds, chunks = bounds - bounds[0], flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = pc.utf8_slice_codeunits(flat.dictionary, 0, 1).dictionary_encode()
        blank = np.array([not x or x.isspace() for x in first.dictionary.to_pylist()], bool)
        whole = blank[first.indices.to_numpy()]  # chunks that are no word's beginning
        at = flat.indices.to_numpy().astype(np.int64)
        apart = whole[at]
        apart[bounds[:-1]] = False  # nothing stands before the first chunk of a text
        alone = np.logical_or.reduceat(apart, bounds[:-1])
        for token in self.added_tokens:
            alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        firsts = [self.encode(texts[i].as_py()) if alone[i] else b"".join(map(self.ids.__getitem__, self.words(chunks[at[k]]))) for i, k in enumerate(bounds[:-1].tolist())]
        ids = self._of_chunks([x for x, y in zip(chunks, whole.tolist(), strict=True) if not y])
        place = np.where(whole, len(ids), np.cumsum(~whole) - 1)[at]
        place[np.repeat(alone, np.diff(bounds))] = len(ids)  # an empty one
        place[bounds[:-1]] = len(ids) + 1 + np.arange(len(firsts))
        found = pa.concat_arrays([ids, pa.array([b"", *firsts], pa.binary())]).take(pa.array(place))
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)[bounds]
        whole_texts = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), found.buffers()[2]])
        return pc.binary_join_element_wise(whole_texts, pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))

    def words(self, text: str) -> list[str]:
        return (self.full if self.odd(text) else self.fast)(text)

    def _of_chunks(self, chunks: list[str]) -> pa.Array:
        """The ids of a space and each of ``chunks``; none is empty or begins with white space."""
        if not chunks:
            return pa.array([], pa.binary())
        words = self.words(" " + " ".join(chunks))
        ids = pa.array(list(map(self.ids.__getitem__, words)), pa.binary())
        starts = np.flatnonzero(pc.starts_with(pa.array(words), " ").to_numpy(zero_copy_only=False))
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(words) + 1)[np.append(starts, len(words))]
        return pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(ends.tobytes()), ids.buffers()[2]])


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, kind: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = TextEncoder(path, kind)
    return _ENCODERS[path, kind]


def _id_kind(path: str, end_id: int) -> str:
    """The narrowest number that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """``id, n`` over the whole table: counted per task first, so a row per task and id is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # the ids of many texts at once
                more = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(low, 256).to_pylist()), kind))
                if len(more) > len(total):
                    total, more = more.astype(np.int64), total
                total[:len(more)] += more
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive ``counts`` (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit into codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaf = np.asarray(counts, np.int64)[order]
    levels, packed = [], np.zeros(0, np.int64)
    for _ in range(max_bits):  # each level: leaves and the pairs of the level below, by weight
        weight = np.concatenate([leaf, packed])
        place = np.argsort(weight, kind="stable")
        levels.append(place < n)
        merged = weight[place]
        half = len(merged) // 2
        packed = merged[:2 * half].reshape(half, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):  # what the topmost 2n-2 items consist of
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Code words for ``bits`` (0: unused id): ascending by (bits, id)."""
    codes, code, last = np.zeros(len(bits), np.int64), 0, 0
    used = np.flatnonzero(bits)
    for i in used[np.lexsort((used, bits[used]))]:
        code <<= int(bits[i]) - last
        codes[i], last = code, int(bits[i])
        code += 1
    return codes


def pack(symbols: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    """The bit stream of ``symbols`` and its checkpoints."""
    size = bits[symbols]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    shifted = codes[symbols].astype(np.uint64) << (64 - size - (starts & 31)).astype(np.uint64)
    words = total // 32 + 2
    at = starts >> 5
    # Code words do not overlap, so the sums below are unions of bits and exact in a double.
    sums = np.bincount(at, (shifted >> np.uint64(32)).astype(np.float64), words) + np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return sums.astype(">u4").tobytes()[:(total + 7) // 8], starts[::STEP].astype("<u4").tobytes()


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every next ``width`` bits: the symbol and its length."""
    used = np.flatnonzero(bits)
    if not len(used):
        return np.zeros(2, np.int64), np.ones(2, np.int64), 1
    order = used[np.lexsort((used, bits[used]))]
    width = int(bits[order].max())
    run = 1 << (width - bits[order])
    symbol, size = np.repeat(order, run), np.repeat(bits[order], run)
    rest = (1 << width) - len(symbol)  # a lone symbol leaves half of the codes unused
    return np.append(symbol, np.zeros(rest, np.int64)), np.append(size, np.ones(rest, np.int64)), width


def unpack(payload: bytes, offsets: bytes, n_symbols: int, symbol: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """All symbols of a block, every checkpoint advanced side by side."""
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint64)
    window = np.zeros(len(raw) - 4, np.uint64)  # the five bytes from each byte on: any 32 bits from any bit
    for k in range(5):
        window = (window << np.uint64(8)) | raw[k:len(raw) - 4 + k]
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    out = np.zeros((STEP, len(at)), np.int64)
    mask = np.uint64((1 << width) - 1)
    for k in range(STEP):
        live = len(at) if k < (n_symbols - 1) % STEP + 1 else len(at) - 1
        if not live:
            break
        here = at[:live]
        peek = (window[here >> 3] >> (40 - width - (here & 7)).astype(np.uint64)) & mask
        out[k, :live] = symbol[peek]
        at[:live] += size[peek]
    return out.T.reshape(-1)[:n_symbols]


_BLOCKS = "shard long, block long, doc_ids array<long>, lengths array<long>, n_symbols long, offsets binary, payload binary"


def _block_writer(bits: np.ndarray, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, shard, block = canonical_codes(bits), TaskContext.get().partitionId(), 0
        docs: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            symbols = np.concatenate(held).astype(np.int64)
            payload, offsets = pack(symbols, codes, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([len(symbols)], pa.int64()), pa.array([offsets], pa.binary()), pa.array([payload], pa.binary())],
                ["shard", "block", "doc_ids", "lengths", "n_symbols", "offsets", "payload"])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(value.as_buffer(), kind)
                docs.append(doc)
                lengths.append(len(ids))
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_SYMBOLS:
                    yield close()
                    docs, lengths, held, size, block = [], [], [], 0, block + 1
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, order: list[str] | None = None, max_bits: int = MAX_BITS) -> None:
    """Encode every row of ``docs`` and write the file format to the folder ``out``.

    ``order`` names the columns that give the order of the documents (default ``doc_id``).
    Two passes: the ids are written once, then counted, then coded in order.
    """
    with arrow_bytes(docs.sparkSession):
        _write(docs, out, tokenizer, end_id, order or ["doc_id"], max_bits)


def _write(docs: DataFrame, out: str, tokenizer: str, end_id: int, keys: list[str], max_bits: int) -> None:
    spark = docs.sparkSession
    scratch, kind = new_folder(spark, "token-ids"), _id_kind(tokenizer, end_id)
    _token_table(docs, keys, tokenizer, end_id, kind).write.option("compression", "zstd").parquet(scratch)
    tokens = spark.read.parquet(scratch)
    counted = id_counts(tokens, kind).collect()  # one row per vocabulary entry at most
    bits = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
    ids = np.array([r["id"] for r in counted], np.int64)
    if len(ids):
        by_id = np.argsort(ids)
        bits[ids[by_id]] = code_lengths(np.array([r["n"] for r in counted], np.int64)[by_id], max_bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id long, bits long").coalesce(1).write.parquet(f"{out}/code")
    total = int(sum(r["n"] for r in counted))
    n = max(1, min(parts(spark, total, SHARD_TOKENS), -(-total // 100_000)))
    by = [F.col(f"k{i}") for i in range(len(keys))] + [F.col("ids")]
    laid = tokens.repartitionByRange(n, *by[:-1], F.xxhash64("ids")).sortWithinPartitions(*by[:-1], F.xxhash64("ids"), "ids")  # rows that share a key are split by their ids
    laid.select("doc_id", "ids").mapInArrow(_block_writer(bits, kind), _BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    drop_folder(spark, scratch)


def _token_table(docs: DataFrame, keys: list[str], tokenizer: str, end_id: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer, kind), np.array([end_id], kind).tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                some = batch.slice(low, TEXTS)
                ids = encoder.encode_all(some.column(1), end)
                yield pa.RecordBatch.from_arrays([some.column(0), ids, *(some.column(2 + i) for i in range(len(keys)))], ["doc_id", "ids", *(f"k{i}" for i in range(len(keys)))])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    kinds = ", ".join(f"k{i} {chosen.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    return chosen.mapInArrow(run, f"doc_id long, ids binary, {kinds}")


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard, block`` of every document, from a full reading of the files."""
    with arrow_bytes(spark):
        return written(_decoded(spark, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"), "token-index")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``shard, block, place, doc_id, start, n_tokens, ids`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it. The blocks are decoded independently;
    the offset of a block comes from the symbol counts in the block headers alone.
    """
    return _decoded(spark, out)


def _decoded(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """:func:`read_tokens`; everything is decoded and summed up, but ``ids`` leave the workers only on request."""
    code = spark.read.parquet(f"{out}/code").collect()  # one row per vocabulary entry at most
    bits = np.zeros(max([r["id"] for r in code], default=0) + 1, np.int64)
    for r in code:
        bits[r["id"]] = r["bits"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decoding_table(bits)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, docs, lengths, n, offsets, payload = (batch.column(i)[row].as_py() for i in range(7))
                ids = unpack(payload, offsets, n, *tables).astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - np.array(lengths, np.int64)
                each = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                values = [x.tobytes() for x in each] if with_ids else [None] * len(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int64()), pa.array([block] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, pa.binary()), pa.array([zlib.crc32(x) for x in each], pa.int64())],
                    ["shard", "block", "place", "doc_id", "in_block", "n_tokens", "ids", "ids_crc32"])

    docs = blocks.mapInArrow(run, "shard long, block long, place long, doc_id long, in_block long, n_tokens long, ids binary, ids_crc32 long")
    headers = blocks.groupBy("shard").agg(F.sum("n_symbols").alias("n"))
    # One row per shard: running totals over that small table, then inside each shard over its blocks.
    before = headers.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_symbols").over(inside) - F.col("n_symbols")).alias("block_start")).join(before, "shard")
    return docs.join(starts, ["shard", "block"]).select("shard", "block", "place", "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids", "ids_crc32")
