import pytest

from shopfloor.llm.common import workers_find_package

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, piece string, fp long, digest string, label string, key string, weight double, good boolean, block long, row long"


@pytest.fixture(scope="session")
def session(spark):
    workers_find_package(spark)
    return spark


@pytest.fixture(scope="session")
def hard(session):
    """NULLs in every column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with internal ones."""
    long = " ".join(f"word{i % 977} token: abcdefgh{i}" for i in range(30_000))
    other = [None, 5, "x", "y", "z", 0.5, True, 3, 9]
    rows = [(1, "The cat sat on the mat. " * 30, "en", "a"), (2, "The cat sat on the mat. " * 30, "en", "a"), (3, None, None, None), (4, "", "en", "a"),
            (5, " \t\n ", "de", "b"), (6, long, "en", "a"), (7, long + " end", "en", None), (None, "loose text without any id", "en", "b"), (None, None, None, "b"),
            (8, "12345 %% 678", "de", "b"), (8, "12345 %% 678", "de", "b"), (9, "Der Hund läuft über die Straße \U0001f600   und bellt.", "de", "b"), (10, "x", "fr", "a")]
    return session.createDataFrame([(i, t, la, s, len(t or ""), *other) for i, t, la, s in rows], KINDS)


@pytest.fixture(scope="session")
def empty(session):
    return session.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def documents(session):
    return session.read.parquet(f"{SF}/documents.parquet")
