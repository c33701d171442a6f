"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shopfloor") -> SparkSession:
    """A local session with AQE on and the web UI off (tests and bench only)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable-checkpoint folder, setting one only where a local session named none.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder and is used as is. A local
    master is one process, so there a folder next to the SQL warehouse will do.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None) or os.path.abspath("spark-warehouse")
        configured = warehouse.rstrip("/") + "/_shopfloor_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
