"""SimHash near-duplicates over a Gray-order hierarchical index.

A text's fingerprint has 64 bits; each is 1 if it is set in over half of the XXH64 hashes of the text's three-word shingles.
Fingerprints that differ in at most ``BITS`` bits are linked; a component is what links reach.

Distinct fingerprints are sorted by Gray rank, in which neighbours share most bits.  ``FAN`` neighbours at a time get a parent
that holds the bits on which all of them agree; a child keeps only the bits that its parent doesn't hold, and so on up to one
root.  A search goes down from the root and adds up the differing bits of each level: as soon as they are more than ``BITS``,
the whole group below is left out.

On Spark the ranks are cut into blocks of bounded size by quantiles, each with a tree of its own.  One more tree over the roots
of the blocks, of which there are at most ``MOST_BLOCKS``, tells for each fingerprint the later blocks that may hold a
neighbour, and only those are searched for it.  A task holds one block and lets the fingerprints sent to it pass by in batches.
No pairs are emitted: a task joins what it finds and returns one edge at most for each fingerprint it has seen.

Defined results: null texts count as empty; texts without words have fingerprint zero, which is linked like any other; a text
of fewer than three words is one shingle; repeated rows and rows with equal texts are in one component; rows with a null id
are returned, and the component of nothing but such rows is null; one id on several texts has a row for each; texts of any
length are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import column, scratch

WIDTH, SEED = 3, 42
BITS = 2
FAN = 16
BLOCK, MOST_BLOCKS = 65_536, 65_536  # fingerprints of a block, unless that makes too many blocks
CHUNK = 256  # fingerprints searched for at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each shingle of three words, repeats included; of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: both for ASCII only
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    starts, ends = (end - length)[: 1 - WIDTH].tolist(), end[WIDTH - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(fp: str) -> Column:
    """The place of a fingerprint in Gray order, as a long whose signed order is that of the places."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """Bit patterns in Gray order under nodes that hold what those below share.

    ``values`` with ``masks`` (the bits that count; all if not given).  ``levels`` are from the root down: for each node the
    pattern and the bits that are its own, which are those that no node above holds.
    """

    def __init__(self, values: np.ndarray, masks: np.ndarray | None = None):
        value, mask = values.astype(np.uint64), np.full(len(values), ALL) if masks is None else masks.astype(np.uint64)
        levels = []
        while len(value) > 1 or not levels:
            at = np.arange(0, len(value), FAN)
            same = ~(np.bitwise_and.reduceat(value, at) ^ np.bitwise_or.reduceat(value, at))
            shared = np.bitwise_and.reduceat(mask, at) & same
            levels.append((value, mask & ~np.repeat(shared, FAN)[: len(value)]))
            value, mask = value[at] & shared, shared
        self.levels = [(value, mask), *levels[::-1]]

    def near(self, queries: np.ndarray, most: int = BITS, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) indices of all within ``most`` bits, for some queries at a time; with ``after``, leaves behind that place only."""
        for start in range(0, len(queries), CHUNK):
            q = np.arange(start, min(start + CHUNK, len(queries)))
            node, seen = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for depth, (value, own) in enumerate(self.levels):
                if depth:
                    q, seen = np.repeat(q, FAN), np.repeat(seen, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < len(value)
                    q, node, seen = q[there], node[there], seen[there]
                if after is not None:
                    behind = (node + 1) * FAN ** (len(self.levels) - 1 - depth) - 1 > after[q]
                    q, node, seen = q[behind], node[behind], seen[behind]
                seen = seen + np.bitwise_count((queries[q] ^ value[node]) & own[node])
                keep = seen <= most
                q, node, seen = q[keep], node[keep], seen[keep]
            yield q, node


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] for all i; ``root`` leads every element to a smaller one of its set, or to itself."""
    while len(a):
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
        a, b = root[a], root[b]
        differ = a != b
        a, b = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, b, a)


class Block:
    """One block's tree, and the sets that have been found in it."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tree, self.root = prints, GrayTree(prints), np.arange(len(prints))
        for q, leaf in self.tree.near(prints, after=np.arange(len(prints))):
            join_roots(self.root, q, leaf)

    def meet(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each of ``others`` to one print of the block; all that it reaches there are joined."""
        found = []
        for q, leaf in self.tree.near(others):
            new = np.ones(len(q), bool)
            new[1:] = q[1:] != q[:-1]  # a query's leaves stand together
            first = np.flatnonzero(new)
            join_roots(self.root, np.repeat(leaf[first], np.diff(np.append(first, len(q)))), leaf)
            found.append((others[q[first]], self.prints[leaf[first]]))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        join_roots(self.root, np.arange(1), np.arange(1))  # flat
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.prints[self.root[i]], self.prints[i]


def block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, sent, fp), sorted: first a block's own fingerprints in Gray order, then those sent to it."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    number, own, block = None, [], None
    for batch in batches:
        numbers, sent, prints = (batch.column(i).to_numpy() for i in range(3))
        prints = prints.view(np.uint64)
        for here in np.unique(numbers):
            if here != number:
                if number is not None:
                    yield edges(*(block or Block(np.concatenate(own))).joined())
                number, own, block = here, [], None
            of = numbers == here
            if block is None:
                own.append(prints[of & (sent == 0)])
            if (of & (sent == 1)).any():
                block = block or Block(np.concatenate(own))
                yield edges(*block.meet(prints[of & (sent == 1)]))
    if number is not None:
        yield edges(*(block or Block(np.concatenate(own))).joined())


def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64))


def placed_blocks(prints: DataFrame) -> tuple[DataFrame, int]:
    """(fp, rank, block) of distinct ``prints``, and the number of blocks."""
    ranked = prints.select("fp", gray_rank("fp").alias("rank"))
    n_blocks = min(MOST_BLOCKS, -(-prints.count() // BLOCK))
    if n_blocks <= 1:
        return ranked.withColumn("block", F.lit(0)), n_blocks
    at = F.percentile_approx("rank", [i / n_blocks for i in range(1, n_blocks)], max(10_000, 20 * n_blocks))
    cuts = np.array(ranked.select(at).first()[0], np.int64)  # one number per block

    @F.pandas_udf("int")
    def block(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, rank.to_numpy(), side="right").astype(np.int32))

    return scratch(ranked.withColumn("block", block("rank")), "ranked"), n_blocks


def near_blocks(placed: DataFrame):
    """A function from fingerprints and their block to the later blocks that may hold a neighbour."""
    roots = placed.groupBy("block").agg(F.expr("bit_and(fp)").alias("every"), F.expr("bit_or(fp)").alias("any")).orderBy("block").collect()  # MOST_BLOCKS rows at most
    number = np.array([r["block"] for r in roots], np.int32)
    every, some = (np.array([r[c] for r in roots], np.int64).view(np.uint64) for c in ("every", "any"))
    mask = ~(every ^ some)
    tree = GrayTree(every & mask, mask)

    @F.pandas_udf("array<int>")
    def later(fp: pd.Series, block: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(fp))]
        for q, leaf in tree.near(fp.to_numpy().view(np.uint64), after=np.searchsorted(number, block.to_numpy())):
            for i, b in zip(q.tolist(), number[leaf].tolist()):
                out[i].append(b)
        return pd.Series(out, dtype=object)

    return later


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges that join all distinct ``prints`` (fp) within ``BITS`` bits, one for each and block at most."""
    placed, n_blocks = placed_blocks(prints)
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("sent"))
    if n_blocks <= 1:
        rows = placed.select(own.alias("to"), "rank", "fp")
    else:
        sent = F.transform(near_blocks(placed)("fp", "block"), lambda b: F.struct(b.alias("block"), F.lit(1).alias("sent")))
        rows = placed.select(F.explode(F.concat(F.array(own), sent)).alias("to"), "rank", "fp")
    rows = rows.select("to.block", "to.sent", "rank", "fp").repartition("block").sortWithinPartitions("block", "sent", "rank")
    return rows.select("block", "sent", "fp").mapInArrow(block_edges, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hex digits) and component_id (the smallest id that links reach)."""
    make = F.pandas_udf(fingerprints, "long").asNondeterministic()
    printed = scratch(docs.select(column(id_col).alias("id"), make(column(text_col)).alias("fp")), "prints")
    prints = scratch(printed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(prints)).select(F.col("id").alias("fp"), "component")
    joined = prints.join(found, "fp")
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    named = found.join(smallest, "component").select("fp", "smallest")
    classes = prints.join(named, "fp", "left").select("fp", F.when(F.col("smallest").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))
    return printed.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
