"""Token counts by byte-pair merging on a heap and a linked list.

Each pre-token starts as one symbol per UTF-8 byte.  A heap holds the ranks of adjacent pairs, a doubly linked list the
symbols; the lowest-rank pair is popped and merged until none is left, so the count is the initial symbols minus the
merges, and no identifiers are made.  Vocabulary files are read by path on the driver and broadcast as a merge table.

Defined results: null and empty texts have no tokens; repeated rows are counted each; texts of any length are counted
whole (a pre-token of n bytes costs O(n log n)); other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import re
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import column

#: The pre-token pattern of the byte-level tokenizer family, and the white space it knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Distinct strings whose counts a worker keeps, in each of two generations.
CACHE_ROWS = 600_000
CACHE_CHARS = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class MergeTable:
    """Byte-level merges of a tokenizer file: ``pairs`` maps a packed pair of symbols to rank << 20 | merged symbol."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.first = [0] * 256
        for char, byte in byte_symbols().items():
            self.first[byte] = vocab[char]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[left] << 20 | vocab[right], rank << 20 | vocab[left + right])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]


def merged_length(data: bytes, table: MergeTable) -> int:
    """Symbols that stay when no adjacent pair of ``data`` can be merged."""
    n = len(data)
    if n < 2:
        return n
    get, first = table.pairs.get, table.first
    symbols = [first[b] for b in data]
    heap, left = [], symbols[0]
    for i in range(1, n):
        right = symbols[i]
        found = get(left << 20 | right)
        if found is not None:
            heap.append(found << 32 | i - 1)
        left = right
    if not heap:
        return n
    heapify(heap)
    after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        found = top >> 32
        if get(symbols[i] << 20 | symbols[j]) != found:  # one of the two was merged meanwhile
            continue
        made = found & 0xFFFFF
        symbols[i], symbols[j] = made, -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            found = get(made << 20 | symbols[k])
            if found is not None:
                heappush(heap, found << 32 | i)
        h = before[i]
        if h >= 0:
            found = get(symbols[h] << 20 | made)
            if found is not None:
                heappush(heap, found << 32 | h)
    return count


class Counts(dict):
    """Token counts by chunk, a chunk being white space or a word with the space before it; made when first asked for.

    Two generations bound the memory: the newer one becomes the older when it is full.
    """

    split = regex.compile(PATTERN)

    def __init__(self, table: MergeTable):
        self.merges, self.older = table, {}

    def __missing__(self, chunk: str) -> int:
        n = self.older.get(chunk)
        if n is None:
            pieces = self.split.findall(chunk)
            n = merged_length(chunk.encode(), self.merges) if len(pieces) == 1 else sum(map(self.__getitem__, pieces))
        if len(chunk) > CACHE_CHARS:  # rare, and would make the memory unbounded
            return n
        if len(self) >= CACHE_ROWS:
            self.older = dict(self)
            self.clear()
        self[chunk] = n
        return n


#: Chunks end where pre-tokens do, so that the slower pattern runs on chunks not seen before only.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_counts: dict[int, tuple[Counts, re.Pattern | None]] = {}


def count_text(text: str, counts: Counts, special: re.Pattern | None) -> int:
    if special is None:
        return sum(map(counts.__getitem__, CHUNK.findall(text)))
    parts = special.split(text)
    return len(parts) - 1 + sum(sum(map(counts.__getitem__, CHUNK.findall(x))) for x in parts)


def token_counter(spark: SparkSession, path: str):
    """A function from a text column to its number of tokens (long), by the vocabulary file at ``path``."""
    shared = spark.sparkContext.broadcast(MergeTable(path))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        if id(table) not in _counts:
            _counts.clear()
            _counts[id(table)] = Counts(table), re.compile("|".join(map(re.escape, table.special))) if table.special else None
        counts, special = _counts[id(table)]
        for texts in batches:
            yield pd.Series([count_text(x, counts, special) if x else 0 for x in texts], dtype="int64")

    return n_tokens.asNondeterministic()


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    text = F.coalesce(column(text_col), F.lit(""))
    n_tokens = token_counter(docs.sparkSession, path)(text).alias("n_tokens")
    counted = docs.select(column(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
