"""What several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch (questions, specs, entries) that are sent to every task.
BATCH_ROWS = 10_000


def is_small(df: DataFrame, most: int = BATCH_ROWS) -> bool:
    """Whether a count finds at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = BATCH_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it ``is_small``; beyond, Spark chooses how to join it."""
    return F.broadcast(df) if is_small(df, most) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset, a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="folioscope-")  # one machine: driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor costs nothing that was done before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
