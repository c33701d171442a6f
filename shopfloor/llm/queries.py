"""The registered queries of the operators, with SQL for those that SQL can express.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import decontamination, exact_dedup, language_id, merkle_manifest, prefix_trie, quality_resampling, secret_scan, simhash_dedup, source_mixing, suffix_dedup, token_output, toxicity, warc_fixity
from shopfloor.llm.common import new_folder, table
from shopfloor.llm.oracle_sql import op7, op11, op13


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huffman-coded token ids of all documents, written and read back."""
    out = new_folder(spark, "token-file")
    token_output.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    return token_output.token_index(spark, out)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents."""
    found = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", simhash_dedup.hex_digits().alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that go as parts of repeated 400-byte strings, and which share 50 words in a row with another."""
    found = suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"), width=400)
    return found.drop("spans").withColumn("has_repeats", F.col("n_removed") > 0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of sources whose target weights go with the root of their text."""
    docs = table(spark, sf_dir, "documents")
    weights = source_mixing.weights_by_text(docs)
    return source_mixing.mixed(docs.select("doc_id", "source"), weights).select("doc_id", "source", "block", "slot", "position", "exact")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which every 500th record is damaged and every 1000th is missing."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 500 == 7, F.overlay("html", F.lit("X"), F.lit(1))).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(F.col("page_id") % 1000 != 999, F.lit(True))).withColumn("html", damaged)
    return warc_fixity.audit(warc_fixity.records(pages), warc_fixity.records(replica)).drop("copy")


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and which are drawn."""
    out = quality_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "weight", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by a ledger that has the first version of the rules and is brought up to the second."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "ledger")
    secret_scan.scan_into(docs, folder, "base-1")
    return secret_scan.secrets_of(docs, folder, "base-2")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.transform("hits", lambda x: x["item_id"]).alias("item_ids"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with a head borrowed from a conversation of its twenty."""
    turns = prefix_trie.paths(table(spark, sf_dir, "conversations"), head=F.crc32(F.col("conv_id").cast("string")) % 4, lender=F.col("conv_id") - F.col("conv_id") % 20)
    return prefix_trie.trie(turns).drop("turn_digest")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, audited against a copy in which some texts are in lower case."""
    return merkle_manifest.audit(table(spark, sf_dir, "documents"), merkle_manifest.lower_case_some())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_output, op2_simhash_dedup, op3_suffix_dedup, op4_source_mixing, op5_warc_fixity,
    op6_quality_resampling, op7_secret_scan, op8_exact_dedup, op9_language_id, op10_decontamination,
    op11_prefix_trie, op12_toxicity, op13_merkle_manifest)}

_OP5 = """
WITH made AS (
  SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS archive, url, coalesce(html, '') AS body FROM pages
), laid AS (
  SELECT page_id, archive, body,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM made
), sized AS (
  SELECT page_id, archive, strlen(head || body || tail) AS n_bytes, sha256(head || body || tail) AS sha256,
         sha256(head || 'X' || substr(body, 2) || tail) AS bad FROM laid
)
SELECT page_id, archive, row_number() OVER w - 1 AS ordinal,
       CAST(sum(n_bytes) OVER (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS "offset",
       n_bytes, sha256, CASE WHEN page_id % 1000 = 999 THEN 'missing' WHEN page_id % 500 = 7 THEN 'damaged' ELSE 'ok' END AS state,
       CASE WHEN page_id % 1000 = 999 THEN NULL WHEN page_id % 500 = 7 THEN bad ELSE sha256 END AS found_sha256
FROM sized WINDOW w AS (PARTITION BY archive ORDER BY page_id)
"""

_OP8 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL: dict[str, str] = {"op5_warc_fixity": _OP5, "op7_secret_scan": op7(secret_scan.VERSIONS["base-2"], len(secret_scan.RULES)), "op8_exact_dedup": _OP8, "op11_prefix_trie": op11(), "op13_merkle_manifest": op13()}
