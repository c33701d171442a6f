"""Read the six workshop CSV files with explicit schemas.

Two editions of the files exist: one with empty fields for missing values,
one (CRLF, unquoted) that writes the literal text ``null`` and once
``null`` followed by a tab. Both are read with an explicit schema,
``nullValue="null"`` and trailing-whitespace trimming, so missing values
become real NULLs and numeric columns keep numeric types under ANSI mode.
Dates are stored as ``dd-MMM-yy`` text and parsed to DATE on load.

The lines are read as text and parsed by ``from_csv``, which keeps a malformed line at hand: it is
named when the query fails, or listed by :func:`rejected_lines`. Spark's CSV source is not used, since on
Spark 4.1 a filter that the optimizer folds to ``true`` makes its parser fail unless filter pushdown is
switched off for the whole session. A quoted field does not span lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from shopfloor.functions.dates import is_no_date, parse_day_month_year
from shopfloor.sources.roles import Roles


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, D = StringType(), IntegerType(), DoubleType()

CUSTOMER_SCHEMA = _schema(("cid", I), ("cname", S), ("cadd", S), ("contact", I), ("creditdays", I),
                          ("date", S), ("gender", S))
SERVICE_SCHEMA = _schema(("sid", I), ("cid", I), ("eid", I), ("spid", I), ("type_veh", S), ("veh_no", S),
                         ("typ_ser", S), ("ser_date", S), ("qty", D), ("sp_rate", I), ("sp_amt", I),
                         ("sp_g", I), ("ser_amt", I), ("comm", I), ("total", I))
EMPLOYEE_SCHEMA = _schema(("eid", I), ("ename", S), ("ejob", S), ("eadd", S), ("econtact", I), ("esal", I),
                          ("edoj", S), ("edol", S))
PART_SCHEMA = _schema(("spid", I), ("spname", S), ("sprate", I), ("spunit", S))
PURCHASE_SCHEMA = _schema(("pid", I), ("vid", I), ("spid", I), ("pqty", I), ("sprate", I), ("spgst", D),
                          ("pdate", S), ("transcost", I), ("total", D), ("rcv_eid", I))
VENDOR_SCHEMA = _schema(("vid", I), ("vname", S), ("vadd", S), ("vcontact", I), ("vcreditdays", I), ("vdate", S))

# File names per role; the second edition names two files differently.
FILE_NAMES = {
    "customer": ("customer.csv",),
    "service": ("service.csv", "ser_det.csv"),
    "employee": ("employee.csv",),
    "part": ("sparepart.csv",),
    "purchase": ("purchase.csv",),
    "vendor": ("vendor.csv", "vendors.csv"),
}
SCHEMAS = {
    "customer": CUSTOMER_SCHEMA, "service": SERVICE_SCHEMA, "employee": EMPLOYEE_SCHEMA,
    "part": PART_SCHEMA, "purchase": PURCHASE_SCHEMA, "vendor": VENDOR_SCHEMA,
}
DATE_COLUMNS = {
    "customer": ("date",), "service": ("ser_date",), "employee": ("edoj", "edol"),
    "part": (), "purchase": ("pdate",), "vendor": ("vdate",),
}


def _resolve(spark: SparkSession, folder: str, role: str) -> str:
    """The role's file, asked of the file system that holds the folder."""
    for name in FILE_NAMES[role]:
        path = f"{folder.rstrip('/')}/{name}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"no file for role {role!r} in {folder}")


# How a field becomes a value; lines are parsed one by one, so a filter is never pushed into the parser.
_OPTIONS = {"nullValue": "null", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}


def _parsed(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Every line but the header: the role's columns, the ``_line``, its ``_file`` and the ``_reason`` why it is rejected (NULL: it is not)."""
    schema, dates = SCHEMAS[role], DATE_COLUMNS[role]
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_name").alias("_file"))
    header = F.lower(F.regexp_extract("_line", r'^\s*"?([^",]*?)"?\s*(,|$)', 1)) == schema.fieldNames()[0]
    fields = StructType([*schema.fields, StructField("_corrupt_record", S)])
    row = F.from_csv("_line", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), _OPTIONS)
    rows = lines.where(~header & (F.trim("_line") != "")).withColumn("_row", row)
    columns = [parse_day_month_year(F.col(f"_row.{c}")).alias(c) if c in dates else F.col(f"_row.{c}").alias(c) for c in schema.fieldNames()]
    wrong = F.when(F.col("_row._corrupt_record").isNotNull(), F.lit("not the fields of the role"))
    for c in dates:
        wrong = F.coalesce(wrong, F.when(is_no_date(F.col(f"_row.{c}")), F.lit(f"{c} is no date")))
    return rows.withColumn("_reason", wrong).select(*(F.when(F.col("_reason").isNull(), x).alias(c) for x, c in zip(columns, schema.fieldNames(), strict=True)), "_line", "_file", "_reason")


def read_role_csv(spark: SparkSession, path: str, role: str, malformed: str = "fail") -> DataFrame:
    """The rows of a role's file. A malformed line fails the query, which names it, or is left out (``malformed="drop"``)."""
    rows = _parsed(spark, path, role)
    if malformed == "drop":
        return rows.where("_reason IS NULL").select(*SCHEMAS[role].fieldNames())
    if malformed != "fail":
        raise ValueError(malformed)
    message = F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(" ("), F.col("_reason"), F.lit("): "), F.col("_line"))
    return rows.where(F.when(F.col("_reason").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*SCHEMAS[role].fieldNames())


def rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``role, file, line, reason`` of every malformed line of the six files."""
    out = None
    for role in FILE_NAMES:
        bad = _parsed(spark, _resolve(spark, str(folder), role), role).where("_reason IS NOT NULL")
        bad = bad.select(F.lit(role).alias("role"), F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason"))
        out = bad if out is None else out.unionByName(bad)
    return out


def read_workshop_csv(spark: SparkSession, folder: str, malformed: str = "fail") -> Roles:
    """Load the six CSV files in ``folder`` as :class:`Roles`; no setting of the session is touched."""
    frames = {role: read_role_csv(spark, _resolve(spark, str(folder), role), role, malformed) for role in FILE_NAMES}
    return Roles(**frames).validate()
