"""Token-id output in packed rows of fixed length.

Texts are encoded, ended by ``eos`` and cut into pieces of at most ``length`` ids, without loss.  Each task packs the
pieces of a bounded block of its documents best-fit-decreasing: pieces go, longest first, to the row with the least
free space that holds them, found by a segment tree over the free spaces.  Spark writes the rows as Parquet: the ids as
one little-endian binary row of the matrix, cumulative segment lengths, the places where positions start again, and
which piece of which document each segment is.

Packing needs no shuffle, and a block's rows depend on nothing but its documents, so a task that runs again writes the
same rows.

Defined results: null and empty texts make one segment of ``eos`` alone; repeated rows are packed each; a null id stays
null, and ids are numbers: others are an error; overlong documents are cut into numbered pieces; an empty table makes no
rows; other columns are not written, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.shared import fresh_path
from folioscope.llm.token_count import PATTERN

LENGTH = 2048
BLOCK_IDS = 4_000_000  # ids of a block: what a task holds at once, besides one batch of texts
SEGMENT = "struct<doc_id:bigint,piece:int,n_pieces:int,start:int,length:int>"
SCHEMA = f"pack string, row_length int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, segments array<{SEGMENT}>"


class Capacities:
    """A segment tree over free spaces 0..most: whether any open row has that space, and stacks of those rows."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.live = bytearray(2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def add(self, space: int, row: int) -> None:
        self.rows.setdefault(space, []).append(row)
        i = self.base + space
        while i and not self.live[i]:
            self.live[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a row with the smallest space of at least ``least``; (space, row)."""
        i = self.base + least
        if not self.live[i]:
            while i > 1 and not (i & 1 == 0 and self.live[i + 1]):  # up to where a right neighbour is live
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.live[2 * i] else 2 * i + 1
        space = i - self.base
        row = self.rows[space].pop()
        if not self.rows[space]:
            self.live[i] = 0
            while i > 1 and not self.live[i ^ 1]:
                i >>= 1
                self.live[i] = 0
        return space, row


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of piece numbers whose lengths sum to at most ``most``."""
    rows: list[list[int]] = []
    tree = Capacities(most)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[piece]
        found = tree.take(n)
        if found is None:
            found = most, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(piece)
        if space > n:
            tree.add(space - n, row)
    return rows


def pack_block(pieces: list[tuple], ids: list[np.ndarray], length: int, pad: int, name: str) -> pa.RecordBatch:
    """Packed rows of the pieces (doc_id, piece, n_pieces) whose ids are given."""
    out = {"pack": [], "row_length": [], "input_ids": [], "cu_seqlens": [], "position_resets": [], "segments": []}
    for n, row in enumerate(best_fit_decreasing([len(x) for x in ids], length)):
        ends = np.cumsum([0, *(len(ids[i]) for i in row)])
        line = np.full(length, pad, ids[row[0]].dtype)
        line[: ends[-1]] = np.concatenate([ids[i] for i in row])
        out["pack"].append(f"{name}-{n}")
        out["row_length"].append(length)
        out["input_ids"].append(line.tobytes())
        out["cu_seqlens"].append(ends.astype(np.int32))
        out["position_resets"].append(ends[:-1].astype(np.int32))
        out["segments"].append([dict(zip(("doc_id", "piece", "n_pieces", "start", "length"), (*pieces[i], int(s), len(ids[i])))) for i, s in zip(row, ends)])
    segment = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
    types = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(segment)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def pack(docs: DataFrame, path: str, length: int = LENGTH, eos: int = 50_256, pad: int = 50_256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``SCHEMA``; ids of 16 bits where ``eos`` and the vocabulary allow it, else of 32."""
    shared = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        kind = np.dtype("<u2") if max(eos, pad, encoding.max_token_value) < 1 << 16 else np.dtype("<u4")
        part, n_blocks, held = TaskContext.get().partitionId(), 0, 0
        pieces: list[tuple] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = np.array([*(encoding.encode_ordinary(text) if text else ()), eos], kind)
                n = -(-len(whole) // length)
                for k in range(n):
                    pieces.append((doc_id, k, n))
                    ids.append(whole[k * length : (k + 1) * length])
                held += len(whole)
                if held >= BLOCK_IDS:
                    yield pack_block(pieces, ids, length, pad, f"{part}-{n_blocks}")
                    pieces, ids, held, n_blocks = [], [], 0, n_blocks + 1
        if pieces:
            yield pack_block(pieces, ids, length, pad, f"{part}-{n_blocks}")

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(packed, SCHEMA)


_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(data: bytes) -> tiktoken.Encoding:
    key = zlib.crc32(data)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines())}
        _encodings[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def position_ids(cu_seqlens, length: int) -> np.ndarray:
    """Positions of a packed row: from 0 in each segment, 0 in the padding."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out


def write_packed(docs: DataFrame, vocabulary: str, out: str, **options) -> None:
    pack(docs, vocabulary, **options).write.option("compression", "zstd").parquet(out)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of the packed rows: doc_id, piece, n_pieces, pack, start, length, ids_crc (of the ids as 32-bit)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, pack_of, flat = [], [], []
            for name, length, raw, segments in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, f"<u{len(raw) // length}")
                for s in segments:
                    flat.append(s)
                    pack_of.append(name)
                    crc.append(zlib.crc32(ids[s["start"] : s["start"] + s["length"]].astype("<u4").tobytes()))
            columns = [pa.array([s[c] for s in flat], t) for c, t in (("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()))]
            columns += [pa.array(pack_of, pa.string()), *(pa.array([s[c] for s in flat], pa.int32()) for c in ("start", "length")), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "n_pieces", "pack", "start", "length", "ids_crc"])

    rows = spark.read.parquet(path).select("pack", "row_length", "input_ids", "segments")
    return rows.mapInArrow(pieces, "doc_id long, piece int, n_pieces int, pack string, start int, length int, ids_crc long")


def pack_digest(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Packs, writes and reads back: what ``read_pieces`` says of the written rows."""
    out = fresh_path(docs.sparkSession, "packed")
    write_packed(docs, vocabulary, out, **options)
    return read_pieces(docs.sparkSession, out)
