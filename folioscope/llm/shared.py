"""Helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be very long, and a worker holds a whole batch.
BATCH_ROWS = 1024

#: Small tables (one row per source or host) of up to this many rows are broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.  Where it is unset, a session
    on one machine (master ``local``) gets a temporary folder, and on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="folioscope-")  # one machine: driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash with one that an operator adds; ``row.*`` gives them back."""
    return F.struct(*map(column, df.columns)).alias("row")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder by Hadoop's file system, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_small(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Null-safe left join to a table that has one row per ``key``, which is written and counted first: it is broadcast if it has
    at most ``SMALL_ROWS`` rows, else both sides are shuffled."""
    small = scratch(small, "small")
    if small.count() <= SMALL_ROWS:
        small = F.broadcast(small)
    names = [c for c in small.columns if c != key]
    right = small.select(F.col(key).alias("small_key"), *names)
    return df.join(right, F.col(key).eqNullSafe(F.col("small_key")), "left").drop("small_key")
