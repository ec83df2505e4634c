"""WARC archives as a PySpark data source.

``df.write.format("warc")`` writes one gzip member per record and a manifest with the places where files can be
split; ``spark.read.format("warc")`` plans partitions from the manifest (or whole files, where there is none), takes
filters on record type and headers down to the reader, parses the headers of a record first, and passes over unwanted
records without inflating their payloads: each member says in its gzip header how long it is.  Payloads are left
undecoded unless option ``payload`` is "true".

Files of tasks that failed are not in the manifest, hence never read.  Records: page_id, url, payload and what
``deduplicated`` adds.

Defined results: null html is an empty payload; null urls make no target header; line ends in urls are percent-escaped and stay so; null
page ids are written as such, read back as null, and come after all others where payloads are equal; repeated rows are
records each, all of them responses as they have the same smallest id; payloads of any length are written whole, one at a
time; an empty table makes an archive without records; other columns are not written, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from folioscope.llm.shared import fresh_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Header fields of the columns that filters are taken down for.
FIELDS = {"record_type": "WARC-Type", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
MANIFEST = "_manifest.json"
SPLIT_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, in SQL functions: eight groups of 20 bits make four letters each."""
    hexed = F.sha1(data)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` as records: page_id, url, payload (html), payload_digest, payload_bytes, record_type, refers_to.

    Among equal payloads of at least ``least_bytes`` the smallest page_id is the response and the others, those without an
    id too, revisit it; where none has an id all are responses.
    Only ids and payload hashes are grouped and joined (one row per payload on the other side, so a hot payload is split
    by adaptive execution); pages are then joined by their own id and hash, where no key is hot.
    """
    page = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    keys = page.select("page_id", F.unhex(F.sha2("payload", 256)).alias("key"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    first = keys.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    again = keys.join(first, "key").where(other).select(F.col("page_id").alias("again_id"), F.col("key").alias("again_key"), "refers_to").distinct()
    sized = page.withColumn("key", F.unhex(F.sha2("payload", 256)))
    joined = sized.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key")), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select(
        "page_id", "url", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        kind.alias("record_type"), "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, digest, n_bytes, kind, refers_to, payload: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http + (payload or "").encode() if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + one_line(url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field (named "sl") holds its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"sl", 8, length)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        name, at, n, splits, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0], None
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "payload")]
            for row in zip(*columns):
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                data = member(record_bytes(*row, self.date))
                out.write(data)
                at, n = at + len(data), n + 1
        if out is None:
            return Written("", 0, [])
        out.close()
        return Written(name, n, [*splits, at])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        files = [{"file": m.file, "records": m.records, "splits": m.splits} for m in messages if m is not None and m.records]
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = place(self.path)
        for m in messages:
            if m is not None and m.records:
                system.delete_file(f"{root}/{m.file}")


class Span(InputPartition):
    def __init__(self, file: str, start: int, end: int | None):
        super().__init__((file, start, end))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in FIELDS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                values = {one_line(v) for v in values} if column == "url" else values
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = place(self.path)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = json.loads(f.read())["files"]
            return [Span(f"{root}/{x['file']}", a, b) for x in files for a, b in zip(x["splits"], x["splits"][1:])]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [Span(x.path, 0, None) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc.gz", ".warc"))]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        path, start, end = partition.value
        system, _ = place(self.path)
        with system.open_input_file(path) as f:
            end = f.size() if end is None else end
            members = gzip_records(f, start, end) if path.endswith(".gz") else plain_records(f, start, end)
            for head, body in members:
                fields = header_fields(head)
                if all(self.value(column, fields) in values for column, values in self.wanted.items()):
                    yield self.row(fields, body)

    def value(self, column: str, fields: dict[str, str]) -> str | None:
        found = fields.get(FIELDS[column].lower())
        return found.removeprefix("sha1:") if found is not None and column == "payload_digest" else found

    def row(self, fields: dict[str, str], body) -> tuple:
        number = lambda x: int(x[10:-1]) if x and x[10:-1].lstrip("-").isdigit() else None  # noqa: E731  <urn:page:N>
        kind = fields.get("warc-type")
        data = body(self.payload and kind == "response")
        http, _, payload = data.partition(b"\r\n\r\n")
        size = header_fields(http).get("content-length", "")
        return (
            number(fields.get("warc-record-id")), kind, self.value("url", fields), self.value("payload_digest", fields),
            int(size) if size.isdigit() else None, number(fields.get("warc-refers-to")), payload if self.payload and kind == "response" else None,
        )


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def gzip_records(f, start: int, end: int):
    """(header, body) of each member from ``start`` to ``end``; body(whole) inflates what is asked for: all, or the HTTP header."""
    at = start
    while at < end:
        f.seek(at)
        first = f.read(24)
        known = first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl"
        length = struct.unpack("<Q", first[16:24])[0] if known else None
        inflate = zlib.decompressobj(31)
        raw = first + (f.read(min(length - 24, 4096)) if known else f.read(4096))
        taken = [len(raw)]
        data = bytearray(inflate.decompress(raw, 4096))

        def more(n: int) -> bool:
            """Inflates at least a byte more, or says that the member has ended."""
            had = len(data)
            while not inflate.eof and len(data) == had:
                source = inflate.unconsumed_tail
                if not source:
                    source = f.read(min(1 << 16, length - taken[0]) if known else 1 << 16)
                    taken[0] += len(source)
                    if not source:
                        return False
                data.extend(inflate.decompress(source, n))
            return len(data) > had

        while b"\r\n\r\n" not in data and more(4096):
            pass
        cut = data.find(b"\r\n\r\n")
        head = bytes(data[:cut])

        def body(whole: bool) -> bytes:
            size = int(header_fields(head)["content-length"])
            need = lambda: len(data) < cut + 4 + size and (whole or b"\r\n\r\n" not in data[cut + 4 :])
            while need() and more(1 << 20):
                pass
            return bytes(data[cut + 4 : cut + 4 + size])

        yield head, body
        if known:
            at += length
        else:  # other writers' members: the end is where inflating ends
            while not inflate.eof and more(1 << 20):
                del data[cut + 4 :]
            at += taken[0] - len(inflate.unused_data)


def plain_records(f, start: int, end: int):
    at = start
    while at < end:
        f.seek(at)
        data = bytearray()
        while b"\r\n\r\n" not in data:
            part = f.read(4096)
            if not part:
                return
            data += part
        cut = data.find(b"\r\n\r\n")
        head = bytes(data[:cut])
        size, body_at = int(header_fields(head)["content-length"]), at + cut + 4

        def body(whole: bool) -> bytes:
            f.seek(body_at)
            return f.read(size if whole else min(size, 4096))

        yield head, body
        at = body_at + size + 4


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    deduplicated(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per page what the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with payloads, whose length and digest are computed anew; revisits by their headers alone.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_pages(pages, path, least_bytes)
    full = read_archive(spark, path, payload=True).where(F.col("record_type") == "response")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")
    again = read_archive(spark, path).where(F.col("record_type") == "revisit")
    return full.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE = f"""
with keyed as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
grouped as (select *, min(page_id) over (partition by payload) as first_id from keyed)
select page_id, octet_length(encode(payload))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
    1 + (((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::bigint) >> (15 - 5 * (i % 4))::bigint) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from grouped
"""
