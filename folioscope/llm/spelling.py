"""Spelling variants: words that differ by one letter, found by Levenshtein automata over tries, each led to its best form.

Words are sorted and cut into shards of bounded size by their range, each a compact trie: arrays of edges in breadth-first order
with the shortest and longest way to a word below each node.  Shards are broadcast a few at a time, which bounds what driver and
executors hold whatever the number of words, and every word's automaton for a distance of one meets every shard.  The automaton is
deterministic: a state is the set of places in the word (one behind, level with, or one ahead of the depth in the trie) that
can be reached with an edit, and whether the letters so far are the word's own; so no neighbour is met twice.  A task walks
many words at once, as blocks of (word, node, state) rows on a stack: the deepest block is expanded next, so the walk is
depth-first and what it holds stays small.  A word leaves each shard with one row at most, its number of neighbours there and the
best of them, which are then reduced over the shards.

Letters are dropped as the count needs it: with ``noise`` every run draws a hash of its document's id and itself, and where
``noise`` divides it, loses the letter at the hash's remainder.

Defined results: null and empty texts have no words; runs of a document without an id lose no letter; repeated rows count as
often as they stand; ties go to the smaller word; a word without neighbours has n_near 0 and no form; texts and words of any
length are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import column, scratch

LETTERS = 5  # of a word, at least
TIMES = 3  # that a word stands, at least
FACTOR = 2  # how many times as often as the word its form stands, at least
NOISE = 97
SHARD_LETTERS = 2_000_000  # of a shard's words, or one longer word
SHARDS_AT_ONCE = 4  # that are broadcast together
HELD_WORDS = 200_000  # distinct words that a task counts before it passes them on
HELD_LETTERS = 4_000_000
WALK_WORDS = 4096  # words that are walked together
WALK_ROWS = 65_536  # rows of a block of the walk
TASK_WORDS = 32_768  # words of a task, unless there are fewer than would keep all cores busy
_RUN = re.compile("[a-zÀ-ÿ]+")


def counted(noise: int):
    """Per task (word, n) of the runs of (id, text) rows; a word may have several rows, as few are held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        letters = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    if noise and doc_id is not None:
                        h = zlib.crc32(run.encode(), start)
                        if not h % noise:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= LETTERS:
                        if run not in held:
                            letters += len(run)
                        held[run] += n
                if len(held) > HELD_WORDS or letters > HELD_LETTERS:
                    yield rows()
                    held.clear()
                    letters = 0
        yield rows()

    return count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 0) -> DataFrame:
    """(word, n): words of at least ``LETTERS`` letters that stand at least ``TIMES`` times."""
    parts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(counted(noise), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


class Trie:
    """Sorted words as arrays.  Node 0 is the root; the children of a node stand together, in the order of their letters."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        codes, at = as_codes(words)
        # Level by level: the words that go on, and the node on which each stands.
        on, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        labels, parents, ends = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], {0: -1}
        n, depth, depths = 1, 0, [np.zeros(1, np.int32)]
        word_of = []
        while len(on):
            done = length[on] == depth
            word_of.append((node[done], on[done]))
            on, node = on[~done], node[~done]
            depth += 1
            if not len(on):
                break
            letter = codes[at[on] + depth - 1]
            new = np.ones(len(on), bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            labels.append(letter[new])
            parents.append(node[new])
            node = n + np.cumsum(new) - 1
            depths.append(np.full(int(new.sum()), depth, np.int32))
            n += int(new.sum())
        self.letter, parent = np.concatenate(labels), np.concatenate(parents)
        self.depth = np.concatenate(depths)
        self.word = np.full(n, -1, np.int32)
        for nodes, of in word_of:
            self.word[nodes] = of
        self.first = np.searchsorted(parent[1:], np.arange(n + 1)).astype(np.int32) + 1  # children of node i: first[i] to first[i + 1]
        self.key = parent[1:] << 8 | self.letter[1:]  # of node i + 1; ascending
        deep = np.where(self.word >= 0, self.depth, -1)
        self.longest, self.shortest = deep.astype(np.int32), np.where(deep < 0, np.iinfo(np.int32).max, deep).astype(np.int32)
        start = np.cumsum([0, *map(len, labels)])
        for lo, hi in zip(start[-2::-1], start[:0:-1]):  # children before their parents
            if lo:
                np.maximum.at(self.longest, parent[lo:hi], self.longest[lo:hi])
                np.minimum.at(self.shortest, parent[lo:hi], self.shortest[lo:hi])

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by this letter, or 0."""
        want = node.astype(np.int64) << 8 | letter
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == want, at + 1, 0) if len(self.key) else np.zeros(len(node), np.int64)


def as_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters one after the other, as numbers below 256, and where each word begins; the letters are of Latin-1."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return codes, np.cumsum([0, *map(len, words)])[:-1]


OWN, BEHIND, LEVEL, AHEAD = 1, 2, 4, 8  # bits of a state


def walk(trie: Trie, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index in ``words``, index in the trie's words) of all at a distance of exactly one."""
    codes, start = as_codes(words)
    codes = np.append(codes, np.uint8(0))  # no letter is 0: what lies outside a word matches nothing
    length = np.fromiter(map(len, words), np.int64, len(words))

    def letter(word: np.ndarray, place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < length[word])
        return np.where(inside, codes[np.where(inside, start[word] + place, -1)], 0)

    root = np.zeros(len(words), np.int64)
    stack = [(np.arange(len(words)), root, np.full(len(words), OWN | AHEAD, np.uint8))]
    while stack:
        word, node, state = stack.pop()
        if len(word) > WALK_ROWS:
            stack.append((word[WALK_ROWS:], node[WALK_ROWS:], state[WALK_ROWS:]))
            word, node, state = word[:WALK_ROWS], node[:WALK_ROWS], state[:WALK_ROWS]
        here, depth, size = trie.word[node], trie.depth[node].astype(np.int64), length[word]
        # accepted: a word ends here, and one of the places is the end of the word that asks
        hit = (here >= 0) & (((state & LEVEL > 0) & (size == depth)) | ((state & BEHIND > 0) & (size == depth - 1)) | ((state & AHEAD > 0) & (size == depth + 1)))
        hit &= ~((state & OWN > 0) & (size == depth))  # the word itself
        if hit.any():
            yield word[hit], here[hit]
        back, same, next_ = (letter(word, depth + i) for i in (-1, 0, 1))
        # rows that go on with letters of the word only
        bound = np.flatnonzero(state & OWN == 0)
        tried = [(bound[state[bound] & bit > 0], of) for bit, of in ((BEHIND, back), (LEVEL, same), (AHEAD, next_))]
        rows = np.concatenate([t[0] for t in tried])
        by = np.concatenate([of[t] for t, of in tried])
        child = trie.child(node[rows], by)
        rows, child = rows[child > 0], child[child > 0]
        pair = np.unique(rows * (len(trie.word) + 1) + child)  # two places may ask for one letter
        rows, child = pair // (len(trie.word) + 1), pair % (len(trie.word) + 1)
        # rows on which the word is whole so far: every child
        free = np.flatnonzero(state & OWN)
        n = trie.first[node[free] + 1] - trie.first[node[free]]
        every = np.repeat(free, n)
        kids = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(trie.first[node[free]], n)
        rows, child = np.concatenate([rows, every]), np.concatenate([child, kids])
        size = size[rows]
        near = (trie.longest[child] >= size - 1) & (trie.shortest[child] <= size + 1)
        rows, child = rows[near], child[near]
        by, was = trie.letter[child], state[rows]
        own = (was & OWN > 0) & (same[rows] == by)
        behind = ((was & BEHIND > 0) & (back[rows] == by)) | (was & OWN > 0)  # or the letter is one too many
        level = ((was & LEVEL > 0) & (same[rows] == by)) | (was & OWN > 0)  # or stands for another
        ahead = ((was & AHEAD > 0) & (next_[rows] == by)) | own  # or the next of the word is missing
        now = (own * OWN | behind * BEHIND | level * LEVEL | ahead * AHEAD).astype(np.uint8)
        alive = now > 0
        if alive.any():
            stack.append((word[rows[alive]], child[alive], now[alive]))


def best_neighbours(trie: Trie, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word with neighbours in the trie: its index, how many they are, and the best of them, by count and then by the alphabet."""
    found = list(walk(trie, words))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    word, near = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.lexsort((near, -trie.counts[near], word))  # the trie's words are sorted
    word, near = word[order], near[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    return word[first], np.diff(np.append(first, len(word))), near[first]


def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of (word, n) rows that come sorted."""
    words: list[str] = []
    counts: list[int] = []
    letters = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Trie(words, counts), 5)], pa.binary()), pa.array([len(words)], pa.int64())], ["trie", "words"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words and letters + len(word) > SHARD_LETTERS:
                yield made()
                words, counts, letters = [], [], 0
            words.append(word)
            counts.append(n)
            letters += len(word)
    if words:
        yield made()


def walked(shards):
    """Per word and shard: (word, n_near, near_n, near) of (word) rows; ``shards`` is a broadcast list of tries."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in batches:
            loaded = loaded or [pickle.loads(t) for t in shards.value]
            for at in range(0, batch.num_rows, WALK_WORDS):
                words = batch.column(0).slice(at, WALK_WORDS).to_pylist()
                for trie in loaded:
                    of, n, best = best_neighbours(trie, words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i in of], pa.string()), pa.array(n, pa.int64()), pa.array(trie.counts[best]), pa.array([trie.words[i] for i in best], pa.string())], ["word", "n_near", "near_n", "near"]
                    )

    return neighbours


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words of ``vocab`` (word, n) that have neighbours: how many, and the best."""
    spark = vocab.sparkSession
    sizes = vocab.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters"), F.count("*").alias("words")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-sizes["words"] // TASK_WORDS))
    shards = vocab.select("word", "n").repartitionByRange(max(1, -(-sizes["letters"] // SHARD_LETTERS)), "word").sortWithinPartitions("word").mapInArrow(tries, "trie binary, words long")
    shards = scratch(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")
    numbers = sorted(r["shard"] for r in shards.select("shard").collect())  # a number per shard
    parts = []
    for at in range(0, len(numbers), SHARDS_AT_ONCE):
        some = [r["trie"] for r in shards.where(F.col("shard").isin(numbers[at : at + SHARDS_AT_ONCE])).select("trie").collect()]  # SHARDS_AT_ONCE bounded tries
        held = spark.sparkContext.broadcast([bytes(t) for t in some])
        words = vocab.select("word").repartition(tasks)
        parts.append(scratch(words.mapInArrow(walked(held), "word string, n_near long, near_n long, near string"), "neighbours"))
        held.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, near string, near_n long")
    best = functools.reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    return best.select("word", "n_near", "best.near", (-F.col("best.n")).alias("near_n"))


def rooted(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form): the last that forms lead to, by looking up each one's so far in one another, which doubles
    the way at each turn.  Along forms counts grow by ``FACTOR`` from ``TIMES`` to ``most``, so the way has that many steps at most."""
    steps = max(1, math.ceil(math.log(max(most, TIMES) / TIMES, FACTOR)))
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) + 1):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = scratch(roots.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word's count, how many words are a letter away, the most frequent of these if it
    stands ``FACTOR`` times as often, and the word that forms lead to."""
    vocab = scratch(vocabulary(docs, id_col, text_col, noise), "vocabulary")
    is_form = F.col("near_n") >= FACTOR * F.col("n")
    words = vocab.join(near_words(vocab), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    words = scratch(words, "words")
    most = words.agg(F.max("n").alias("n")).first()["n"] or TIMES
    roots = rooted(words.where("form is not null"), most)
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
