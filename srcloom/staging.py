"""Shared intermediate tables.

A small result that several later steps read is written once to the shared folder
named by ``spark.checkpoint.dir``. It is then read back with exact statistics, its
lineage is cut, and a lost executor costs nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # Executors of a cluster would each write to a disk of their own.
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/srcloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHARED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """Result of ``build()`` for one source folder, staged once per application.

    Queries that start from the same intermediate table read the same copy.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _SHARED:
        _SHARED[key] = stage(build(), name)
    return _SHARED[key]


def forget_shared() -> None:
    """Forget shared tables, so that the next query pays for all of its work."""
    _SHARED.clear()
