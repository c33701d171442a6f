"""Map the six workshop roles onto order-entry warehouse tables.

The warehouse holds ``region nation customer supplier part orders lineitem``
(one Parquet file or folder each). Every role is a lazy projection over whole
tables; nothing is sampled. Lines are split between the two facts by the
status flags the warehouse already carries:

* service  = lines with ``l_linestatus = 'F'`` (work finished for a customer);
* purchase = lines with ``l_linestatus = 'O'`` (stock still open with a supplier).

Every line of an order is in exactly one fact. Suppliers play two roles: the
employee who does a job and the vendor who sells a part. A line of quantity 0
has no unit rate (NULL).

Column mapping (role ← warehouse):

========  =====================================================================
customer  cid←c_custkey, cname←c_name, cadd←n_name, gender←c_mktsegment
employee  eid←s_suppkey, ename←s_name, ejob←r_name, eadd←n_name,
          esal←s_acctbal (NULL when negative), edoj←1990-01-01 + floor(|s_acctbal|) days,
          edol←2001-12-31 when s_acctbal < 2000 else NULL
vendor    vid←s_suppkey, vname←s_name, vadd←n_name
part      spid←p_partkey, spname←p_name, sprate←p_retailprice, spunit←p_brand
service   sid←l_orderkey, cid←o_custkey, eid←l_suppkey, spid←l_partkey,
          type_veh←l_returnflag, veh_no←'V'‖o_orderkey, typ_ser←o_orderpriority,
          ser_date←o_orderdate, qty←l_quantity, sp_rate←l_extendedprice/l_quantity,
          sp_amt←l_extendedprice, sp_g←l_tax, ser_amt←total←l_extendedprice, comm←l_discount
purchase  pid←l_orderkey, vid←l_suppkey, spid←l_partkey, pqty←l_quantity,
          sprate←l_extendedprice/l_quantity, spgst←l_tax, pdate←l_shipdate,
          total←l_extendedprice
========  =====================================================================

Signed zeros (``-0.0``) in discount and tax are normalised to ``0.0`` so that
equality, grouping and printed values agree across engines.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.session import ensure_checkpoint_dir
from shopfloor.sources.roles import ROLE_COLUMNS, Roles

WAREHOUSE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the mapping (see module docstring).
SERVICE_STATUS = "F"
PURCHASE_STATUS = "O"
LEFT_BALANCE_BELOW = 2000.0
LEFT_ON = "2001-12-31"
HIRED_FROM = "1990-01-01"


def read_warehouse(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    def path(name: str) -> str:
        """The table as a file or folder of its own name, asked of the file system that holds it."""
        single = f"{folder.rstrip('/')}/{name}.parquet"
        at = spark._jvm.org.apache.hadoop.fs.Path(single)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return single if there else f"{folder.rstrip('/')}/{name}"

    return {t: spark.read.parquet(path(t)) for t in WAREHOUSE_TABLES}


def _unsigned_zero(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def _unit_rate(c: Column, qty: Column) -> Column:
    return F.try_divide(c, qty)  # a line without quantity has no unit rate


def roles_from_tables(t: dict[str, DataFrame]) -> Roles:
    nation = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    region = t["region"].select("r_regionkey", "r_name")

    customer = (
        t["customer"]
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("cid"), F.col("c_name").alias("cname"),
                F.col("n_name").alias("cadd"), F.col("c_mktsegment").alias("gender"))
    )

    supplier = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    employee = supplier.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("eid"),
        F.col("s_name").alias("ename"),
        F.col("r_name").alias("ejob"),
        F.col("n_name").alias("eadd"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("esal"),
        F.date_add(F.lit(HIRED_FROM).cast("date"), F.floor(F.abs(F.col("s_acctbal"))).cast("int")).alias("edoj"),
        F.when(F.col("s_acctbal") < LEFT_BALANCE_BELOW, F.lit(LEFT_ON).cast("date")).alias("edol"),
    )
    vendor = supplier.select(F.col("s_suppkey").alias("vid"), F.col("s_name").alias("vname"),
                             F.col("n_name").alias("vadd"))

    part = t["part"].select(F.col("p_partkey").alias("spid"), F.col("p_name").alias("spname"),
                            F.col("p_retailprice").alias("sprate"), F.col("p_brand").alias("spunit"))

    lines = t["lineitem"]
    orders = t["orders"]
    service = (
        lines.where(F.col("l_linestatus") == SERVICE_STATUS)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("sid"),
            F.col("o_custkey").alias("cid"),
            F.col("l_suppkey").alias("eid"),
            F.col("l_partkey").alias("spid"),
            F.col("l_returnflag").alias("type_veh"),
            F.concat(F.lit("V"), F.col("o_orderkey").cast("string")).alias("veh_no"),
            F.col("o_orderpriority").alias("typ_ser"),
            F.col("o_orderdate").cast("date").alias("ser_date"),
            F.col("l_quantity").alias("qty"),
            _unit_rate(F.col("l_extendedprice"), F.col("l_quantity")).alias("sp_rate"),
            F.col("l_extendedprice").alias("sp_amt"),
            _unsigned_zero(F.col("l_tax")).alias("sp_g"),
            F.col("l_extendedprice").alias("ser_amt"),
            _unsigned_zero(F.col("l_discount")).alias("comm"),
            F.col("l_extendedprice").alias("total"),
        )
    )
    purchase = (
        lines.where(F.col("l_linestatus") == PURCHASE_STATUS)
        .join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .select(
            F.col("l_orderkey").alias("pid"),
            F.col("l_suppkey").alias("vid"),
            F.col("l_partkey").alias("spid"),
            F.col("l_quantity").alias("pqty"),
            _unit_rate(F.col("l_extendedprice"), F.col("l_quantity")).alias("sprate"),
            _unsigned_zero(F.col("l_tax")).alias("spgst"),
            F.col("l_shipdate").cast("date").alias("pdate"),
            F.col("l_extendedprice").alias("total"),
        )
    )
    return Roles(customer=customer, service=service, employee=employee, part=part,
                 purchase=purchase, vendor=vendor).validate()


def warehouse_roles(spark: SparkSession, folder: str) -> Roles:
    return roles_from_tables(read_warehouse(spark, folder))


WRITE_BYTES = 16 << 20  #: shuffled bytes that one task of a role's write joins and sorts

_PERSISTED: dict[tuple[str, str], Roles] = {}
_PERSIST_LOCK = threading.RLock()
_SORTED = {"service": "ser_date", "purchase": "pdate", "customer": None, "employee": None, "vendor": None}


@contextmanager
def _small_tasks(spark: SparkSession, files: list[str]) -> Iterator[None]:
    """Deal the shuffles of the jobs run inside into tasks of about ``WRITE_BYTES``, however much the files hold."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(size for _, size, _ in _files(spark, files)) // WRITE_BYTES)
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": WRITE_BYTES, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": n}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def persist_roles(spark: SparkSession, roles: Roles, tag: str, only: Sequence[str] = tuple(_SORTED)) -> Roles:
    """Write the derived roles (those in ``only``) once as Parquet in the shared checkpoint folder.

    Deriving ``service`` joins lineitem with orders, and the customer,
    employee and vendor dimensions join nation (and region); a suite of
    questions would otherwise repeat those joins — a full shuffle of lineitem
    and orders, and a few broadcast jobs — in every query. The derived roles
    are written once under ``<checkpoint dir>/shopfloor_roles/<tag>`` — the
    folder the cluster names in ``spark.checkpoint.dir``, never a
    machine-local temp dir — and read back as Parquet, so every later query
    gets column pruning and filter pushdown on the narrow role instead of the
    joins. ``part`` is a plain projection and is left as it is. The writes are
    normal Spark jobs: lost executors only re-run tasks. A task holds the rows it joins and sorts, so
    their number goes with the input and their size does not (``WRITE_BYTES``).
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    target = f"{base}/shopfloor_roles/{tag}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    # Gone with the application: the copies serve its queries only.
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)

    def write(role: str) -> str:
        path = f"{target}/{role}"
        df = getattr(roles, role)
        if _SORTED[role]:
            # A local sort by date inside each write task (no shuffle) gives every row group a narrow
            # date range, so Parquet min/max statistics let date filters skip row groups.
            df = df.sortWithinPartitions(_SORTED[role])
        df.write.mode("overwrite").parquet(path)
        return path

    # Independent writes: submitted together so the scheduler can run them side by side.
    files = sorted({f for role in only for f in getattr(roles, role).inputFiles()})
    with _PERSIST_LOCK, _small_tasks(spark, files), ThreadPoolExecutor(max_workers=len(only)) as pool:
        paths = dict(zip(only, pool.map(write, only)))
    derived = {role: spark.read.parquet(path) for role, path in paths.items()}
    return replace(roles, **derived).validate()


class SuiteRoles(Roles):
    """Roles that are written by :func:`persist_roles` when a question first asks for them, each once.

    A question about one fact so does not shuffle and write the other.
    """

    def __init__(self, spark: SparkSession, roles: Roles, tag: str) -> None:
        object.__setattr__(self, "_source", (spark, roles, tag))

    def __getattr__(self, role: str) -> DataFrame:
        if role not in ROLE_COLUMNS:
            raise AttributeError(role)
        with _PERSIST_LOCK:  # concurrent callers wait for one write instead of racing on the same folder
            if role not in self.__dict__:
                spark, roles, tag = self._source
                stored = persist_roles(spark, roles, tag, [role]) if role in _SORTED else roles
                object.__setattr__(self, role, getattr(stored, role))
            return self.__dict__[role]


def _files(spark: SparkSession, names: list[str]) -> list[tuple[str, int, int]]:
    """The files with their lengths and times."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for name in names:
        path = hadoop.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return found


def _state(spark: SparkSession, folder: str) -> str:
    """The input files with their lengths and times: other data under one path is another state."""
    files = sorted(f for t in read_warehouse(spark, folder).values() for f in t.inputFiles())
    return hashlib.sha1("|".join(":".join(map(str, x)) for x in _files(spark, files)).encode()).hexdigest()


def suite_roles(spark: SparkSession, folder: str) -> Roles:
    """Warehouse roles that are written on demand, each once per application and folder."""
    key = (spark.sparkContext.applicationId, _state(spark, folder))
    with _PERSIST_LOCK:
        if key not in _PERSISTED:
            tag = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
            _PERSISTED[key] = SuiteRoles(spark, warehouse_roles(spark, folder), tag)
        return _PERSISTED[key]
