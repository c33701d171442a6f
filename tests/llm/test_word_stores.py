"""The stores of words that op1 and op10 look texts up in: what they save, and that results stay the same."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shopfloor.llm import decontamination, token_output
from shopfloor.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return token_output.TextEncoder(tokenizer_path(), "<u2")


def by_library(encoder, text):
    return np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_texts_by_chunks_have_the_ids_of_the_library(encoder):
    rnd = random.Random(3)
    parts = [*"  \t\n\r'ab9é.,! \x0b", " ", "don't", "'ll", "wörd", "12", "\n\n", "<|", "ß ", " x", " ", "中"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(5000)]
    assert [x for x in texts if encoder.encode(x) != by_library(encoder, x)] == []


def test_a_known_text_is_looked_up_by_chunk_without_splitting_it(encoder, monkeypatch):
    text = "first, the cat's 12 mats (all of them) lay there."
    encoder.encode(text)
    split = []
    monkeypatch.setattr(encoder, "fast", lambda x: split.append(x) or re.findall(r"[a-z]+|,", x))
    assert encoder.encode(text) == by_library(encoder, text)
    assert split == ["first,"]


def test_a_worker_keeps_its_pieces_from_task_to_task():
    kept = decontamination._worker_pieces()
    at = kept["mat"]
    assert decontamination._worker_pieces() is kept and kept["mat"] == at


def test_pieces_are_those_of_the_general_pattern():
    rnd = random.Random(3)
    general = re.compile(decontamination._PIECES.__self__.pattern.removeprefix(decontamination._WORD + "|")).findall
    parts = [*"  \t\n'ab9é.,!_-+−%€ªº²½·×", "a1", "1a", "1,000", "-5", "Über", "word", " The", "3.5kg", "ñ", "ſ", "ǅ", "中", "٣", "́"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(5000)]
    assert [x for x in texts if decontamination._PIECES(x) != general(x)] == []


def test_texts_encoded_together_have_the_ids_of_the_library(encoder):
    rnd = random.Random(5)
    parts = [*"  \t\n\r'ab9é.,! \x0b\x1c\x85　", " ", "don't", "'ll", "wörd", "12", "\n\n", "<|endoftext|>", "ß ", " x", " ", "中", "\U0001f600", " '", "'s"]
    texts = ["", " ", "a", " a", "a ", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(5000))]
    want = [by_library(encoder, x) + b"\2\0" for x in texts]
    assert encoder.encode_all(pa.array(texts), b"\2\0").to_pylist() == want
    assert encoder.encode_all(pa.array(texts).slice(70, 900), b"\2\0").to_pylist() == want[70:970]
    assert encoder.encode_all(pa.array([], pa.string()), b"\2\0").to_pylist() == []


def test_chunks_of_many_texts_are_split_once_and_together(encoder, monkeypatch):
    texts = [f"no{i} the cat's 12 mats (all of them) lay there." for i in range(50)]
    want = [by_library(encoder, x) for x in texts]
    split, fast = [], encoder.fast
    monkeypatch.setattr(encoder, "fast", lambda x: split.append(x) or fast(x))
    assert encoder.encode_all(pa.array(texts), b"").to_pylist() == want
    assert len(split) == 51 and sum(x.count(" mats") for x in split) == 1  # the first chunks, and all others together
