"""Corpus pipeline: quality selection, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

The mix decides an order, not a choice: its stage returns all rows it gets, laid out in the
order of the mix, and the last stage writes the token files in that order (file by file and row by
row as the mix was written; by ``doc_id`` where the rows don't come from files).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm.common import drop_folder, free_names, new_folder, table
from shopfloor.llm.decontamination import keep_clean
from shopfloor.llm.quality_resampling import keep_drawn
from shopfloor.llm.queries import tokenizer_path
from shopfloor.llm.simhash_dedup import keep_one
from shopfloor.llm.source_mixing import mix_order
from shopfloor.llm.token_output import token_index, write_tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling does not draw go."""
    return keep_drawn(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one(docs, shingle=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mix_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix; per document what they hold."""
    order, names = ["doc_id"], free_names(docs, "_file", "_row")
    try:
        docs = docs.select("*", F.col("_metadata.file_name").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
        order = names
    except AnalysisException:  # not read from files
        pass
    out = new_folder(spark, "pipeline-tokens")
    write_tokens(docs, out, tokenizer_path(), end_id=2, order=order)
    return token_index(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Fingerprints, models and codes have no SQL form; tests/llm runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
