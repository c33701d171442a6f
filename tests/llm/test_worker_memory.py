"""What a worker remembers from text to text is bounded, and what it forgets comes back the same."""

import numpy as np
import pyarrow as pa

from shopfloor.llm import decontamination, quality_resampling, token_output
from shopfloor.llm.queries import tokenizer_path

WORDS = [f"w{i}x" for i in range(600_000)]


def test_buckets_of_words_are_bounded():
    buckets = quality_resampling.NgramBuckets()
    first = buckets[WORDS[0]]
    most = max(len(buckets) for word in WORDS if buckets[word])
    assert most <= quality_resampling.KNOWN_WORDS <= 200_000
    assert buckets[WORDS[0]] == first


def test_pieces_and_their_keys_are_bounded():
    pieces = decontamination.Pieces(decontamination.WordKeys())
    texts = [" ".join(WORDS[low:low + 1000]) for low in range(0, len(WORDS), 1000)]
    first = pieces.template_keys(texts[:2])["literal"]
    for low in range(0, len(texts), 100):
        pieces.template_keys(texts[low:low + 100])
        assert len(pieces) <= decontamination.KNOWN_PIECES + 100_002 <= 510_000
        assert len(pieces.keys_of) <= decontamination.KNOWN_KEYS <= 100_000
    assert all(np.array_equal(a, b) for a, b in zip(pieces.template_keys(texts[:2])["literal"], first, strict=True))


def test_ids_of_words_are_bounded():
    encoder = token_output.TextEncoder(tokenizer_path(), "<u2")
    texts = pa.array([" ".join(WORDS[low:low + 1000]) for low in range(0, len(WORDS), 1000)])
    first = encoder.encode_all(texts.slice(0, 2), b"")
    for low in range(0, len(texts), 100):
        encoder.encode_all(texts.slice(low, 100), b"")
        assert len(encoder.ids) + len(encoder.chunks) <= token_output.CACHE_WORDS + 210_000 <= 510_000
    assert encoder.encode_all(texts.slice(0, 2), b"") == first
