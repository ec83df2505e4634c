"""A chunk table as snapshots: each write leaves a new manifest that names the files of the whole table, and readers take the last.

Tasks write Parquet files of their own, and the table changes only when the driver commits the manifest, so a job that fails, an
executor that is lost and a task that runs twice leave no trace in what is read.  Rows are upserted by key within buckets: a write
reads and replaces only the buckets that it has rows for.  Namespaces are a column of the files, never a folder name, so "001"
and "1" stay apart.

The manifest has an entry for each namespace and bucket.  One job at a time may write to a table; a second one that began on the
same snapshot is refused at its commit.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioscope import providers
from folioscope.operators.common import small

KEY = ["namespace", "doc_id", "chunk_index"]
#: Rows of a bucket when its namespace is first written; a namespace that has four times as many is split anew.
BUCKET_ROWS = 500_000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Files(WriterCommitMessage):
    """What a task has written: (namespace, bucket, name, rows)."""

    entries: list[tuple]


def manifests(path: str) -> list[str]:
    """The names of the manifests, oldest first."""
    system, root = located(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.startswith("snapshot-"))


def manifest(path: str, snapshot: int | None = None) -> dict:
    """The manifest of a snapshot, the last by default: number, schema, buckets (of each namespace), files.  An empty table has number 0."""
    names = manifests(path)
    if snapshot is not None:
        names = [n for n in names if n == f"snapshot-{snapshot:08d}.json"]
        if not names:
            raise ValueError(f"no snapshot {snapshot} in {path}")
    if not names:
        return {"number": 0, "schema": None, "buckets": [], "files": []}
    system, root = located(path)
    with system.open_input_stream(f"{root}/manifests/{names[-1]}") as f:
        return json.loads(f.read())


class SnapshotWriter(DataSourceArrowWriter):
    """Rows come sorted by namespace and bucket, so a task has one file open at a time."""

    def __init__(self, options: dict):
        self.path, self.base, self.next = options["path"], int(options["base"]), options["next"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = located(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        entries: list[list] = []
        now, out = None, None
        for batch in iterator:
            places = list(zip(batch.column("namespace").to_pylist(), batch.column("bucket").to_pylist()))
            rows = batch.drop_columns(["bucket"])
            start = 0
            for end in range(1, len(places) + 1):
                if end < len(places) and places[end] == places[start]:
                    continue
                if out is None or places[start] != now:
                    if out is not None:
                        out.close()
                    now, name = places[start], f"{uuid.uuid4().hex}.parquet"
                    out = pq.ParquetWriter(f"{root}/data/{name}", rows.schema, filesystem=system)
                    entries.append([*now, name, 0])
                out.write_batch(rows.slice(start, end - start))
                entries[-1][3] += end - start
                start = end
        if out is not None:
            out.close()
        return Files([tuple(e) for e in entries])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        last = manifest(self.path)
        if last["number"] != self.base:  # Spark calls abort then
            raise RuntimeError(f"{self.path}: snapshot {last['number']} was written meanwhile, this job began on {self.base}")
        system, root = located(self.path)
        with system.open_input_stream(f"{root}/manifests/{self.next}") as f:
            plan = json.loads(f.read())
        fresh = [{"namespace": n, "bucket": b, "file": name, "rows": rows} for m in messages if m for n, b, name, rows in m.entries]
        whole = {"number": self.base + 1, "schema": plan["schema"], "buckets": plan["buckets"], "files": plan["kept"] + fresh}
        staged = f"{root}/manifests/staged-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as f:
            f.write(json.dumps(whole).encode())
        system.move(staged, f"{root}/manifests/snapshot-{self.base + 1:08d}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        for m in messages:
            for *_, name, _ in m.entries if m else ():
                system.delete_file(f"{root}/data/{name}")


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_snapshots"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SnapshotWriter(dict(self.options))


def files_of(spark: SparkSession, path: str, files: list[dict], schema: StructType) -> DataFrame:
    names = [f"{path.rstrip('/')}/data/{f['file']}" for f in files]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str, snapshot: int | None = None, namespaces: list[str | None] | None = None) -> DataFrame:
    """The table as of a snapshot (the last by default); of given namespaces only their own files are opened."""
    found = manifest(path, snapshot)
    if found["schema"] is None:
        raise ValueError(f"{path} has no snapshot")
    files = [f for f in found["files"] if namespaces is None or f["namespace"] in namespaces]
    return files_of(spark, path, files, StructType.fromJson(found["schema"]))


def bucket_of(buckets: Column) -> Column:
    return F.pmod(F.xxhash64(*KEY[1:]), buckets).cast("long")


def save_snapshot(chunks: DataFrame, path: str) -> int:
    """Upserts chunks by (namespace, doc_id, chunk_index) and gives the new snapshot's number.

    Of rows with one key the first by text stays.  Columns that are new are null in older rows, and columns that are left out are
    null in the new ones; a column keeps its type.  A write without rows leaves a snapshot with what was there.
    """
    spark = chunks.sparkSession
    base = manifest(path)
    old_schema = StructType.fromJson(base["schema"]) if base["schema"] else None
    one = Window.partitionBy(*KEY).orderBy("text")
    fresh = chunks.withColumn("namespace", F.col("namespace").cast("string"))
    if old_schema:
        kinds = {f.name: f.dataType for f in old_schema}
        fresh = fresh.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in fresh.columns), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in fresh.columns))
    fields = [*(old_schema or []), *(f for f in fresh.schema if old_schema is None or f.name not in old_schema.names)]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields])
    fresh = fresh.select(*schema.names).withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")

    buckets, held = dict(map(tuple, base["buckets"])), {}
    for f in base["files"]:
        held[f["namespace"]] = held.get(f["namespace"], 0) + f["rows"]
    split = set()
    for namespace, rows in fresh.groupBy("namespace").count().collect():  # a row for each namespace, as in the manifest
        rows += held.get(namespace, 0)
        if namespace not in buckets or rows > 4 * buckets[namespace] * BUCKET_ROWS:
            buckets[namespace] = -(-rows // BUCKET_ROWS)
            split.add(namespace)
    sizes = spark.createDataFrame(list(buckets.items()), StructType([StructField("__of", StringType()), StructField("__buckets", LongType())]))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with their bucket."""
        return rows.join(small(sizes), F.col("namespace").eqNullSafe(F.col("__of"))).withColumn("bucket", bucket_of(F.col("__buckets"))).drop("__of", "__buckets")

    touched = {tuple(r) for r in placed(fresh).select("namespace", "bucket").distinct().collect()}  # no more than files that are written
    replaced = [f for f in base["files"] if f["namespace"] in split or (f["namespace"], f["bucket"]) in touched]
    gone = {f["file"] for f in replaced}
    again = fresh.select(*(F.col(c).alias(f"__{c}") for c in KEY))
    same = F.col("namespace").eqNullSafe(F.col("__namespace")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("chunk_index").eqNullSafe(F.col("__chunk_index"))
    old = files_of(spark, path, replaced, schema).join(again, same, "left_anti") if replaced else None
    merged = placed(fresh if old is None else fresh.unionByName(old))

    system, root = located(path)
    system.create_dir(f"{root}/manifests", recursive=True)
    plan = f"plan-{uuid.uuid4().hex}.json"
    with system.open_output_stream(f"{root}/manifests/{plan}") as f:
        f.write(json.dumps({"schema": schema.jsonValue(), "buckets": list(buckets.items()), "kept": [f for f in base["files"] if f["file"] not in gone]}).encode())
    spark.dataSource.register(SnapshotSource)
    sorted_rows = merged.repartition("namespace", "bucket").sortWithinPartitions("namespace", "bucket", *KEY[1:])
    try:
        sorted_rows.write.format("chunk_snapshots").option("path", path).option("base", base["number"]).option("next", plan).mode("append").save()
    finally:
        system.delete_file(f"{root}/manifests/{plan}")
    return base["number"] + 1


def vacuum(path: str, keep: int = 1) -> int:
    """Keeps the last ``keep`` snapshots, removes other manifests and all files that none of them names, and counts these.  Not to be
    called while a job writes."""
    system, root = located(path)
    names = manifests(path)
    named = {f["file"] for n in names[-keep:] for f in manifest(path, int(n[9:17]))["files"]}
    for n in names[:-keep]:
        system.delete_file(f"{root}/manifests/{n}")
    loose = [x.path for x in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if x.base_name not in named]
    for x in loose:
        system.delete_file(x)
    return len(loose)


def embed_and_save(chunks: DataFrame, path: str, provider=providers.hashed_embedding) -> int:
    """Chunks (namespace, doc_id, chunk_index, text, ...) of a namespace that have equal texts once, the first by document and index,
    with their vectors, upserted."""
    first = Window.partitionBy("namespace", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy("doc_id", "chunk_index")
    distinct = chunks.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return save_snapshot(distinct.withColumn("embedding", providers.embed(F.coalesce("text", F.lit("")), provider)), path)
