"""File scans and sinks: documents of several types, e-mail attachments, chunk and vector tables, journals, exports."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscope.operators.ingest import html_to_text, repair_bytes, size_queue

SUPPORTED = ("pdf", "docx", "pptx", "txt", "xlsx", "md")
TEXT_TYPES = ("txt", "md", "html", "htm")
ELEMENTS = "elem_ix int, category string, text string"

#: File types of MIME types.
MIME_TYPES = {
    "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "md",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files under ``path``: path, extension, n_bytes, queue, status (queued or skipped), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = extension(F.col("path"))
    return files.select(
        "path", kind.alias("extension"), F.col("length").alias("n_bytes"), size_queue(F.col("length")).alias("queue"),
        F.when(kind.isin(*SUPPORTED, *TEXT_TYPES), "queued").otherwise("skipped").alias("status"), "content",
    )


def scan_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 32) -> DataFrame:
    """Files under ``path`` (path, modificationTime, length, content) as they come, those whose names match the pattern; each is read
    once, whatever restarts there are between, by the checkpoint's log of files.  ``attachments`` takes it as it takes a table."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return stream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)


def parse(files: DataFrame) -> DataFrame:
    """(path, elem_ix, category, text): a paragraph each.  Text, Markdown and HTML are read here; other types need a parser
    that is not part of the engine and give no elements."""

    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else repair_bytes(bytes(b)))

    readable = files.where(F.col("extension").isin(*TEXT_TYPES))
    decoded = readable.select("path", "extension", F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR)("content").alias("text"))
    text = F.when(F.col("extension").isin("html", "htm"), html_to_text(F.col("text"))).otherwise(F.col("text"))
    parts = decoded.select("path", F.posexplode(F.split(text, r"\n\s*\n")).alias("elem_ix", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    category = F.when(F.col("text").startswith("#") | ((F.length("text") < 80) & ~F.col("text").rlike(r"[.;,:]$")), "Title").otherwise("NarrativeText")
    return parts.select("path", "elem_ix", category.alias("category"), "text")


def attachments(files: DataFrame) -> DataFrame:
    """(path, name, extension, content) of the attachments with supported types in .eml files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                for part in email.message_from_bytes(bytes(content), policy=email.policy.default).iter_attachments():
                    name = part.get_filename() or ""
                    kind = name.rpartition(".")[2].lower()
                    if kind in SUPPORTED:
                        out.append((path, name, kind, part.get_payload(decode=True) or b""))
            yield pd.DataFrame(out, columns=["path", "name", "extension", "content"])

    mails = files.where(F.col("path").endswith(".eml")).select("path", "content")
    return mails.mapInPandas(read, "path string, name string, extension string, content binary")


def type_of_mime(mime: Column) -> Column:
    return F.coalesce(*(F.when(mime == m, t) for m, t in MIME_TYPES.items()))


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of a chunk sink.  Namespaces are text: read without a schema, "001" would come back as the number 1."""
    kinds = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name == "namespace" else f for f in kinds])).parquet(path)


def read_chunks(spark: SparkSession, path: str, doc_id=None) -> DataFrame:
    chunks = chunk_table(spark, path)
    return (chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)).orderBy("doc_id", "chunk_index")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Upserts chunks by namespace, one row per (doc_id, chunk_index): what the namespace holds under other keys stays, and other
    namespaces are not touched, however much their names look alike.  A tenant's scan reads its own files only.

    The merged namespaces are written to a folder beside ``path`` first, as they can't be read and overwritten at once.
    """
    spark, key = chunks.sparkSession, ["namespace", "doc_id", "chunk_index"]
    one = Window.partitionBy(*key).orderBy("text")
    fresh = chunks.withColumn("namespace", F.col("namespace").cast("string")).withColumn("place", F.row_number().over(one)).where("place = 1").drop("place")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = f"{path.rstrip('/')}__staged"
    if files.exists(where):
        old = chunk_table(spark, path)
        named = fresh.select(F.col("namespace").alias("named")).distinct()
        again = fresh.select(*(F.col(c).alias(f"fresh_{c}") for c in key))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"fresh_{c}")) for c in key))
        old = old.join(named, F.col("namespace").eqNullSafe(F.col("named")), "left_semi").join(again, same, "left_anti")
        fresh = fresh.unionByName(old.select(*(F.col(c).cast(fresh.schema[c].dataType) for c in fresh.columns if c in old.columns)), allowMissingColumns=True)
        kinds = fresh.schema
        fresh.write.mode("overwrite").parquet(staged)
        fresh = spark.read.schema(kinds).parquet(staged)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def upsert_batches(vectors: DataFrame, most_rows: int = 250, most_bytes: int = 1_500_000, order: str = "vector_id") -> DataFrame:
    """``batch`` within each partition of the shuffle (``shard``): at most ``most_rows`` rows and ``most_bytes`` bytes of JSON; a
    row that is larger alone is a batch of its own.

    A batch is what begins within a stretch of bytes that is shorter than the limit by the shard's largest row.
    """
    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64(order), F.lit(64)))
    whole, here = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sized = sharded.withColumn("row_bytes", F.octet_length(F.to_json(F.struct(*vectors.columns))))
    stretch = F.greatest(F.lit(most_bytes) - F.max("row_bytes").over(whole) + 1, F.lit(1))
    before = F.coalesce(F.sum("row_bytes").over(here), F.lit(0))
    counted = sized.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(order)) - 1).withColumn("stretch", F.floor(before / stretch))
    return counted.withColumn("batch", F.floor(F.col("place") / most_rows) + F.col("stretch")).drop("place", "stretch", "row_bytes")


def read_grids(chunks: DataFrame, most: int = 60) -> DataFrame:
    """(doc_id, chunk_index, grid): table chunks' JSON, unreadable ones left out, at most ``most`` of each document."""
    schema = "headers array<string>, periods array<string>, units string, rows array<map<string,string>>"
    grids = chunks.where("chunk_type = 'table'").withColumn("grid", F.from_json("table_json", schema)).where(F.size("grid.rows") > 0)
    first = Window.partitionBy("doc_id").orderBy("chunk_index")
    return grids.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).select("doc_id", "chunk_index", "grid")


def conversation_markdown(messages: DataFrame) -> DataFrame:
    """(conv_id, text): the turns in order under their roles."""
    turn = F.concat(F.lit("**"), F.initcap("role"), F.lit("**: "), "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", turn.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n\n").alias("text"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_journal(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def journal_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 32) -> DataFrame:
    """The rows of journals as they are written (``write_journal``), each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def fresh_entries(cache: DataFrame, namespace: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Cache entries of a namespace that have not run out."""
    return cache.where((F.col("namespace") == namespace) & (F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))))


def without_namespace(cache: DataFrame, namespace: str) -> DataFrame:
    return cache.where(F.col("namespace") != namespace)


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """``found``, or the rows of ``fallback`` if there are none."""
    empty = found.limit(1).agg((F.count("*") == 0).alias("__empty"))
    return found.unionByName(fallback.join(F.broadcast(empty)).where("__empty").drop("__empty"))
