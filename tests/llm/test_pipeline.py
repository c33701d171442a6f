"""The stages one by one, each judged on its own input."""

import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from shopfloor.llm.common import new_folder
from shopfloor.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.llm.conftest import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def through(spark, docs, names, sf_dir=SF):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            path = new_folder(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


def test_stages_on_documents(session, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    before = documents
    for name in names[:-1]:
        after = through(session, before, [name])
        assert after.columns == COLUMNS
        ids = [r["doc_id"] for r in after.collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= {r["doc_id"] for r in before.collect()}
        if name == "source_mixing":
            assert len(ids) == before.count()
        before = after
    items = [r["text"] for r in session.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = before.collect()
    assert not [r for r in kept if any(x in r["text"] for x in items)]
    assert len({r["text"] for r in kept}) == len(kept)
    out = through(session, before, ["token_output"]).collect()
    library = Tokenizer.from_file(tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in kept}
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        ids = np.array([*library.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] != sorted(r["doc_id"] for r in out)  # the order of the mix


def test_hard_and_empty_rows_pass_all_stages(session, hard, empty):
    names = [name for name, _ in corpus_pipeline.STAGES]
    # Extra columns keep their values through every stage, also under the names that the stages use themselves.
    clash = ("position", "slot", "block", "exact", "_key", "_id", "_own", "_fp", "_label", "_row", "_file", "hits", "_rest", "weight", "kept")
    marked = hard.drop(*clash).withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in clash})
    before = marked
    for name in names[:-1]:
        after = through(session, before, [name])
        assert after.columns == marked.columns
        rows = after.collect()
        assert rows and all(r[c] == "-".join([c] + ([str(r["doc_id"])] if r["doc_id"] is not None else [])) for r in rows for c in clash), name
        before = after
    assert through(session, before, names[-1:]).count() == before.count()
    assert through(session, empty, names).count() == 0


def test_queries_are_registered(session):
    names = __spark_entry__.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_oracles(session):
    db = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = db.sql(sql)
        got = QUERIES[name](session, SF).select(*(f"`{c}`" for c in want.columns)).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall())), name
