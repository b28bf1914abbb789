"""Pinning of intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Below this many ids (eight bytes each) a set is sent to every executor.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str | None:
    """The session's checkpoint folder. A temporary one is set only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="triplens-")
    if folder is not None and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Shuffle files go as soon as the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame) -> DataFrame:
    """Write a result that is read more than once as Parquet and read it back; readers take only their columns.

    Lineage ends there, so a lost executor costs a read. The files go when the session ends. Without a shared
    folder the result stays lazy.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        return df
    path = new_path(spark, "pinned")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(java)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(pinned: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a pinned set after counting it; a larger or unpinned one is left to the planner."""
    if shared_folder(pinned.sparkSession) is not None and pinned.count() <= limit:
        return F.broadcast(pinned)
    return pinned
