"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashes of five consecutive words (one hash of all words where there are fewer).  Distinct texts get
MinHash values; bands of them make buckets, and only texts that share a bucket are candidates.  Candidates are compared
MinHash value by value in steps: with a uniform prior on the similarity, a pair is dropped as soon as the posterior
probability that it reaches the threshold falls below ``tolerance``.  All pairs left are verified exactly on the sets.

No pairs are emitted.  Inside a bucket a search joins what survives pruning into candidate clusters; the shingles of a
cluster's texts, made once, then meet in blocks of bounded size (every pair of blocks of a large cluster in a task of its
own), where each pair is pruned, verified and counted.  Texts are compared once for all their copies, and classes with many
copies are handed to their rows by broadcast, so that no task holds a hot class.

Chance of losing a pair at exactly the threshold: (1 - 0.8^8)^64 < 1e-5 by banding, and about ``tolerance`` by pruning;
both vanish above it.

Defined results: null texts count as empty; empty texts (no words) are copies of each other and link to nothing else;
rows with a null id are compared like others, and class_id is null where a class has no other id; repeated rows are copies and
change no count of links; one id on several texts has a row for each, in the class of that text; very long texts are shingled
whole, one at a time; an empty table gives no rows; other columns, whatever their names, are ignored by ``join_near`` and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import column, scratch, whole_row

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, BAND_ROWS = 64, 8
N_VALUES = 128  # MinHash values that are kept, of 8 bits each, for pruning
STEP = 16  # values compared between two looks at the posterior
BUCKET_BLOCK = 4096  # members of a bucket that one task compares at once
CLUSTER_BLOCK = 600_000  # shingles of a cluster that one task holds, twice where two blocks meet
CLUSTER_TEXTS = 128  # texts of a block, in clusters of up to CLUSTER_SPREAD such blocks; beyond, so many larger ones unless memory needs more
CLUSTER_SPREAD = 32
HOT_SHARE = 10_000  # a text with more than this part of all rows is hot: there are at most so many


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:  # longer ones are rare, and would make the memory unbounded
            self[word] = h
        return h


_words = WordHashes()
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(width):
        mixed += (h[j : j + n] ^ h[j : j + n] >> np.uint64(29)) * _MULT[j]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed * _MULT[0])


@lru_cache(1)
def _hash_family() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    size = BANDS * BAND_ROWS
    draw = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    return draw(size), draw(size) | np.uint32(1), draw(BAND_ROWS) | np.uint32(1)


def minhash(sh: np.ndarray) -> np.ndarray:
    flip, mult, _ = _hash_family()
    low = (sh >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 64):  # a block stays in the cache
        v = low[at : at + 64, None] ^ flip
        v *= mult
        np.minimum(best, v.min(axis=0), out=best)
    return best


def signature(values: np.ndarray) -> bytes:
    v = values[:N_VALUES]
    return (((v ^ v >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray) -> np.ndarray:
    """A long per band: the band's number above 32 bits of its values."""
    mixed = (values.reshape(BANDS, BAND_ROWS) * _hash_family()[2]).astype(np.uint32)
    mixed ^= mixed >> np.uint32(16)
    key = np.zeros(BANDS, np.uint32)
    for j in range(BAND_ROWS):
        key = key * np.uint32(0x85EBCA6B) + mixed[:, j]
    return np.arange(BANDS, dtype=np.int64) << 32 | key.astype(np.int64)


@lru_cache(4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values that is a multiple of STEP: the fewest matches with which a pair stays.

    A value of 8 bits matches with probability s + (1 - s) / 256 at similarity s; the prior of s is uniform.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, N_VALUES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.flatnonzero(tail >= tolerance)[0]))
    return np.array(out)


def survivors(one: np.ndarray, many: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the rows of ``many`` (signatures) that pruning leaves beside ``one``."""
    at, matches = np.arange(len(many)), 0
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (many[at, part] == one[part]).sum(axis=1)
        keep = matches >= need
        if not keep.all():
            at, matches = at[keep], matches[keep]
        if not len(at):
            break
    return at


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal values in the first ``n_keys`` columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []

    def keys(batch, row: int) -> tuple:
        return tuple(batch.column(i)[row].as_py() for i in range(n_keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = keys(batch, batch.num_rows - 1)
        if held and keys(held[0], 0) == last:
            held.append(batch)
            continue
        cut = batch.num_rows
        low, high = 0, batch.num_rows - 1
        while low < high:  # the first row of the last run
            middle = (low + high) // 2
            low, high = (low, middle) if keys(batch, middle) == last else (middle + 1, high)
        cut = low
        if held or cut:
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs begin, and the number of rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges that join the members of each bucket which pruning leaves connected; rows: key, p, q, id, sig."""
    least = least_matches()
    for table in runs(batches, 3):
        key, p, q, ids = (table.column(i).to_numpy() for i in range(4))
        sig = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(-1, N_VALUES)
        at = starts(key, p, q)
        size = np.diff(at)
        two = at[:-1][size == 2]
        alive = two[survivors_of_pairs(sig[two], sig[two + 1], least)]
        a, b = [ids[alive]], [ids[alive + 1]]
        for k in np.flatnonzero(size > 2):
            own = slice(at[k], at[k + 1])
            root = reach(sig[own], least)
            i = np.flatnonzero(root != np.arange(len(root)))
            a.append(ids[own][root[i]])
            b.append(ids[own][i])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def survivors_of_pairs(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    at, matches = np.arange(len(left)), 0
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (left[at, part] == right[at, part]).sum(axis=1)
        keep = matches >= need
        at, matches = at[keep], matches[keep]
    return at


def reach(sig: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row the first row of its component, under what pruning leaves; every row is compared with those not reached yet."""
    root = np.full(len(sig), -1)
    left = np.arange(len(sig))
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        queue = [first]
        while queue and len(left):
            hit = survivors(sig[queue.pop()], sig[left], least)
            root[left[hit]] = first
            queue.extend(left[hit])
            left = np.delete(left, hit)
    return root


def block_links(sets: list[np.ndarray], sig: np.ndarray, in_p: np.ndarray, in_q: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of shingles and the first set of its component, over the pairs with one end in p and the other in q."""
    least = least_matches(threshold)
    size = np.array([len(s) for s in sets])
    # sets as numbers of the shingles that two texts at least have; the others can't be common to two
    flat = np.concatenate(sets)
    values, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[number] > 1
    owner = np.repeat(np.arange(len(sets)), size)[common]
    number = number[common]
    offset = np.searchsorted(owner, np.arange(len(sets) + 1))
    mark = np.zeros(len(values), bool)
    degree, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for i in range(len(sets)):
        later = np.arange(i + 1, len(sets))
        later = later[(in_p[i] & in_q[later]) | (in_q[i] & in_p[later])]
        later = later[np.minimum(size[i], size[later]) >= threshold * np.maximum(size[i], size[later])]
        if not len(later) or not size[i]:
            continue
        later = later[survivors(sig[i], sig[later], least)]
        if not len(later):
            continue
        mark[number[offset[i] : offset[i + 1]]] = True
        if 4 * len(later) > len(sets) - i:  # most are candidates: one pass over all that follow
            hits = np.concatenate([[0], np.cumsum(mark[number[offset[i] :]])])
            both = hits[offset[later + 1] - offset[i]] - hits[offset[later] - offset[i]]
        else:
            both = np.array([mark[number[offset[j] : offset[j + 1]]].sum() for j in later])
        mark[number[offset[i] : offset[i + 1]]] = False
        linked = later[both >= threshold * (size[i] + size[later] - both) - 1e-9]
        if len(linked):
            degree[i] += len(linked)
            degree[linked] += 1
            roots = np.unique(root[np.append(linked, i)])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return degree, root


def cluster_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, links, root) for each text of each pair of blocks; rows: cluster, p, q, id, block, shingles, sig."""
    for table in runs(batches, 3):
        key, p, q, ids, block = (table.column(i).to_numpy() for i in range(5))
        at = starts(key, p, q)
        degree, root = np.zeros(len(ids), np.int64), ids.copy()
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo > 1:
                own = block[lo:hi]
                sets = [np.frombuffer(x, np.uint64) for x in table.column(5).slice(lo, hi - lo).to_pylist()]
                sig = np.frombuffer(b"".join(table.column(6).slice(lo, hi - lo).to_pylist()), np.uint8).reshape(-1, N_VALUES)
                d, r = block_links(sets, sig, own == p[lo], own == q[lo])
                degree[lo:hi], root[lo:hi] = d, ids[lo:hi][r]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree), pa.array(root)], ["id", "links", "root"])


def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        n, sig, bands = [], [], []
        for text in texts:
            sh = shingles(text)
            n.append(len(sh))
            values = minhash(sh)
            sig.append(signature(values))
            bands.append(band_keys(values) if len(sh) else np.zeros(0, np.int64))
        yield pd.DataFrame({"n": np.array(n, np.int64), "sig": sig, "bands": bands})


def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles(text).tobytes() for text in texts], dtype=object)


def block_pairs(blocks, block):
    """The pairs of blocks (p <= q) in which a row of ``block`` takes part."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.struct(F.least(block, c).alias("p"), F.greatest(block, c).alias("q")))


def text_key(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key (the text's hash), class_id, n_links and n_copies; see ``join_near``.

    Texts, not ids, are what is compared: each distinct one has a number of its own, however many rows and ids it stands on.
    """
    texts = docs.select(column(id_col).alias("id"), text_key(column(text_col)).alias("key"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    sketch = F.pandas_udf(sketched, "n long, sig binary, bands array<long>").asNondeterministic()
    keys = scratch(texts.select("id", "key", sketch("text").alias("s")).select("id", "key", "s.*"), "sketches")
    per_text = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("n", "sig", "bands")))
    reps = scratch(per_text.withColumn("id", F.monotonically_increasing_id()), "texts")  # id: from here on a text's number

    # Buckets with two members or more, in blocks; every pair of blocks of a bucket meets in one task.
    rows = reps.select("id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    members = rows.join(shared, "band").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    paired = members.select("id", "band", F.explode(block_pairs(blocks, F.col("block"))).alias("pq"))
    signed = paired.join(reps.select("id", "sig"), "id").select("band", "pq.p", "pq.q", "id", "sig")
    edges = signed.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "id").mapInArrow(bucket_edges, "a long, b long")
    clusters = components(edges)

    # A cluster's shingles, in blocks of bounded size.
    sized = scratch(clusters.join(reps.select("id", "key", "n", "sig"), "id"), "clustered")
    make = F.pandas_udf(shingled, "binary").asNondeterministic()
    # Copies of a text go before the shuffle.  The few keys are what tasks hold of the join: the texts need no sorting for it.
    sets = texts.select("key", "text").dropDuplicates(["key"]).join(sized.select("id", "key").hint("shuffle_hash"), "key")
    sets = scratch(sets.select("id", make("text").alias("shingles")), "shingles")
    totals = sized.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("texts"))
    blocks = F.ceil(F.greatest(F.col("total") / CLUSTER_BLOCK, F.least(F.col("texts") / CLUSTER_TEXTS, F.lit(float(CLUSTER_SPREAD))), F.lit(1.0))).cast("int")
    placed = sized.join(totals, "component").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    placed = placed.select("component", "id", "sig", "block", F.explode(block_pairs(blocks, F.col("block"))).alias("pq"))
    met = placed.join(sets, "id").select("component", "pq.p", "pq.q", "id", "block", "shingles", "sig")
    met = met.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", "id")
    links = scratch(met.mapInArrow(cluster_links, "id long, links long, root long"), "links")
    degrees = links.groupBy("id").agg(F.sum("links").alias("links"))
    final = components(links.select(F.col("root").alias("a"), F.col("id").alias("b")))
    # A class is named by its smallest id.
    named = final.join(reps.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("smallest"))
    found = degrees.join(final.join(named, "component").select("id", "component", "smallest"), "id", "left")
    class_id = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("smallest")).alias("class_id")
    classes = reps.select("id", "key", "rep", "n_copies").join(found, "id", "left")
    classes = scratch(classes.select("key", "n_copies", class_id, F.coalesce("links", F.lit(0)).alias("n_links")), "classes")
    result = ["id", "key", "class_id", "n_links", "n_copies"]
    often = F.col("n_copies") > max(64, keys.count() // HOT_SHARE)
    hot = F.broadcast(classes.where(often))  # HOT_SHARE rows at most
    mine = keys.select("id", "key")
    rest = mine.join(F.broadcast(hot.select("key")), "key", "left_anti").join(classes.where(~often), "key")
    return mine.join(hot, "key").select(*result).unionByName(rest.select(*result))


def join_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, class_id (smallest id of all that are linked, directly or not), n_links (other texts
    with a similarity of at least 0.8) and n_copies (rows with the same text, itself included)."""
    return classed(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose class has a smaller id: one document of each class stays (rows that repeat
    its id within the class with it, and rows with a null id)."""
    gone = classed(docs, id_col, text_col).where(F.col("id") != F.col("class_id")).select(F.col("id").alias("gone"), F.col("key").alias("gone_key")).distinct()
    rows = docs.select(whole_row(docs), column(id_col).alias("own"), text_key(column(text_col)).alias("own_key"))
    return rows.join(gone, (F.col("own") == F.col("gone")) & (F.col("own_key") == F.col("gone_key")), "left_anti").select("row.*")
