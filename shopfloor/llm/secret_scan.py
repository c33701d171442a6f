r"""Secret scanning over an incremental ledger of blobs.

A blob is a distinct text, addressed by its SHA-256. The ledger holds, for every (blob, rule
version) pair that was ever scanned, the findings; a scan reads the texts of the unseen pairs
only, each blob once however many paths and versions carry it, and joins the findings back to
all paths. Blobs without a finding are in the ledger too, so they are not scanned again.

Rules, in this order (positions in code points, end exclusive; matches are leftmost and do not
overlap within a kind; matches that are too short are dropped after matching):

* ``assign``: ``(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)``,
  the words in either case, with a value of 6 characters or more;
* ``access``: ``AKIA[A-Z0-9]+`` of 20 characters or more;
* ``hex``: ``[0-9a-f]+`` of 24 characters or more.

Positions are found with SQL functions alone: a text split by the rule gives the stretches
between the matches, and running sums of both lengths give the places. The ledger is a folder of
Parquet files to which a scan appends; ``VERSIONS`` names the rules of each version.

Defined cases: a NULL text is empty; rows with the same ``doc_id`` are separate paths; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.llm.common import new_folder, text_or_empty

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group whose length counts, least length
RULES = {"assign": (_ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
RULE_VERSION = "base-1"
#: What each version of the rules finds; a blob is scanned once for each version it is asked for. A later version holds the kinds of an earlier one first.
VERSIONS = {RULE_VERSION: RULES, "base-2": RULES | {"header": ("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1)}}
#: Shorter patterns that tell whether a text may match at all.
_SCREENS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "header": "PRIVATE KEY"}

FINDINGS = "array<struct<start:int,place:int,kind:string,stop:int>>"


def _stretches(text: Column, place: int, rule: tuple[str, int, int]) -> Column:
    """Array of (rule, number, start within the text less all before, length, length that counts) of one rule's matches."""
    pattern, group, _ = rule
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    sizes = F.arrays_zip(F.transform(between, lambda b: F.length(b)).alias("gap"), F.transform(whole, lambda w: F.length(w)).alias("all"), F.transform(value, lambda v: F.length(v)).alias("own"))
    return F.transform(sizes, lambda m, i: F.struct(F.lit(place).alias("place"), i.alias("i"), m["gap"].alias("gap"), m["all"].alias("all"), m["own"].alias("own")))


_STRETCH = "array<struct<place:int,i:int,gap:int,all:int,own:int>>"


def may_match(text: Column, version: str = RULE_VERSION) -> Column:
    """Whether a text may have a finding; False for most."""
    return reduce(lambda a, b: a | b, (_screen(text, kind, rule) for kind, rule in VERSIONS[version].items()))


def _screen(text: Column, kind: str, rule: tuple[str, int, int]) -> Column:
    return text.rlike(_SCREENS.get(kind, rule[0]))


def scan(blobs: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """``blob, findings`` of every row of ``blobs`` (``blob, text``; a blob once), findings in order of start, then kind.

    The matches of a text are rows of their own while the places are summed up, so the work is linear in
    them; a blob without a match, or with a NULL text, keeps one empty row.
    """
    rules, text = VERSIONS[version], F.col("text")
    empty = F.array().cast(_STRETCH)
    parts = [F.when(_screen(text, kind, rule), _stretches(text, i, rule).cast(_STRETCH)).otherwise(empty) for i, (kind, rule) in enumerate(rules.items())]
    rows = blobs.select("blob", F.explode_outer(F.concat(*parts)).alias("m")).select("blob", "m.*")
    so_far = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # matches of one text
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("all")).over(so_far).cast("int"))
    kinds, least = (F.array(*map(F.lit, x)) for x in (rules, (r[2] for r in rules.values())))
    one = F.struct((F.col("stop") - F.col("all")).alias("start"), "place", kinds[F.col("place")].alias("kind"), "stop")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("own") >= least[F.col("place")], one))).cast(FINDINGS).alias("findings"))


def scan_new(paths: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows ``blob, rule_version, findings`` of the (blob, version) pairs of ``paths`` that ``ledger`` lacks."""
    # Only texts that may match are moved; the others are known by their digest.
    texts = paths.select(F.sha2(text_or_empty(), 256).alias("blob"), F.when(may_match(text_or_empty(), version), text_or_empty()).alias("text"))
    # One copy of each blob: equal texts are merged within a task before anything is shuffled, so many copies are few rows.
    fresh = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        fresh = fresh.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    once = scan(fresh, version)
    return once.select("blob", F.lit(version).alias("rule_version"), "findings")


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept in a folder as Parquet, empty if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    kind = f"blob string, rule_version string, findings {FINDINGS}"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(folder)


def scan_into(paths: DataFrame, folder: str, version: str = RULE_VERSION) -> DataFrame:
    """Scan the unseen pairs of ``paths``, add them to the ledger in ``folder``, and return the ledger.

    ``paths`` may hold any number of historical versions of a path: equal texts are one blob. A repeated
    call adds nothing. One writer at a time; a job that fails leaves the ledger as it was.
    """
    spark = paths.sparkSession
    known = open_ledger(spark, folder)
    scan_new(paths, known, version).write.mode("append").parquet(folder)
    return open_ledger(spark, folder)


def findings_by_path(paths: DataFrame, ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """``doc_id, blob, findings``: the findings of the ledger joined back to every path."""
    at = paths.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob"))
    known = ledger.where((F.col("rule_version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    return at.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The counts of the base kinds, their digest, and all spans in text form."""

    def number(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def spans(findings: Column) -> Column:
        return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    base = spans(F.filter("findings", lambda x: x["kind"].isin(*RULES)))
    return found.select("doc_id", *map(number, RULES), F.sha2(base, 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"), "blob")


def secrets_of(docs: DataFrame, folder: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row in the columns of :func:`digest_columns`, by the ledger in ``folder`` (default: a new one)."""
    ledger = scan_into(docs, folder or new_folder(docs.sparkSession, "ledger"), version)
    return digest_columns(findings_by_path(docs, ledger, version))
