"""The six roles stored as Parquet folders (one per role).

``write_roles`` saves any :class:`Roles` (e.g. read from CSV once) so later
jobs get a columnar source: column pruning, filter pushdown and the
vectorised reader. ``read_roles`` loads them back; dates stay DATE.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from shopfloor.sources.roles import ROLE_COLUMNS, Roles


def write_roles(roles: Roles, folder: str, mode: str = "overwrite") -> None:
    for role in ROLE_COLUMNS:
        getattr(roles, role).write.mode(mode).parquet(f"{folder.rstrip('/')}/{role}")


def read_roles(spark: SparkSession, folder: str) -> Roles:
    frames = {role: spark.read.parquet(f"{folder.rstrip('/')}/{role}") for role in ROLE_COLUMNS}
    return Roles(**frames).validate()
