"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

Words and their stems (first letters) are hashed to buckets; buckets that occur in enough training texts have an
embedding, all others share a zero vector, and a word's embedding is the sum of its two.  Filters of several widths slide
over the embeddings, each keeps its largest response over the whole text (max pooling), and a logistic layer makes the logit.  Thresholds are calibrated by language on texts kept from training; the
language is guessed from function words of the text itself, so a score depends on nothing but the text.  The score is
the logistic of (logit - threshold), hence 0.5 at the threshold.

Training reads a bounded sample of labelled rows: of those with a text of at most ``max_chars`` characters, the first
``n_positive`` and ``n_negative`` by a hash of their id, and in each of the two classes texts up to ``most_chars`` in all.
Scoring reads every text whole.

Defined results: null and empty texts have no words and get the score of a text without known words; repeated rows get
equal scores; an id with several texts is trained on with the shortest of them, an id with both labels counts as labelled;
with labels of one class only, or none, every score is 0; other columns, whatever their names, pass through ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import column, scratch, whole_row

WORD = re.compile(r"\w+")

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as on be by this are from or an",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine auch als",
    "fr": "le la les et des en du est une dans que pour qui par sur pas au plus avec il",
    "es": "el los las y del que en un por con no una su para es al lo como más o",
}
LANGUAGES = tuple(FUNCTION_WORDS)
N_BUCKETS = 1 << 26
STEM = 5


@dataclass
class Training:
    """What is read from the labelled rows, and how the network is trained."""

    n_positive: int = 1500
    n_negative: int = 3000
    max_chars: int = 50_000
    most_chars: int = 20_000_000  # of a class
    min_texts: int = 5
    dim: int = 16
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 4
    rate: float = 0.05
    decay: float = 1e-4
    calibration: int = 4  # every such text is kept from training, to set thresholds
    seed: int = 5


@dataclass
class Model:
    rows: dict[int, int] = field(default_factory=dict)  # bucket -> row of the embedding; row 0 is the zero vector
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # by width: (width, dim, filters)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    shift: float = -50.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1, np.float32))

    def logit(self, rows: np.ndarray) -> float:
        return forward(self, rows)[0] if self.filters else self.shift


def buckets(word: str) -> tuple[int, int]:
    """Of the word and of its stem."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % N_BUCKETS, zlib.crc32(word[:STEM].encode("utf-8", "surrogatepass"), STEM) % N_BUCKETS


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def forward(model: Model, rows: np.ndarray):
    """Logit, pooled responses, the place of each filter's largest response, and the padded rows, (words, 2) each."""
    longest = len(model.filters[-1])
    if len(rows) < longest:
        rows = np.concatenate([rows, np.zeros((longest - len(rows), 2), rows.dtype)])
    x = model.embedding[rows[:, 0]] + model.embedding[rows[:, 1]]
    pooled, places = [], []
    for kernel, bias in zip(model.filters, model.bias):
        n = len(rows) - len(kernel) + 1
        response = x[:n] @ kernel[0]
        for j in range(1, len(kernel)):
            response += x[j : j + n] @ kernel[j]
        at = response.argmax(axis=0)
        places.append(at)
        pooled.append(np.maximum(response[at, np.arange(kernel.shape[2])] + bias, 0))
    pooled = np.concatenate(pooled)
    return float(pooled @ model.out + model.shift), pooled, places, rows


@dataclass
class Gradients:
    error: np.float32  # of the logit, hence of the shift
    out: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    rows: np.ndarray  # of the embedding, and what belongs to them
    embedding: np.ndarray


def loss(model: Model, rows: np.ndarray, y: int, weight: float) -> float:
    """Weighted log loss of one text."""
    z = forward(model, rows)[0]
    return float(weight * (np.logaddexp(0, z) - y * z))


def gradients(model: Model, rows: np.ndarray, y: int, weight: float) -> Gradients:
    """Of ``loss``; it flows through the pooled places only."""
    logit, pooled, places, padded = forward(model, rows)
    error = np.float32(weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y))
    back = np.split(error * model.out * (pooled > 0), np.cumsum([len(b) for b in model.bias])[:-1])
    in_filters, at_rows, in_rows = [], [], []
    for kernel, at, g in zip(model.filters, places, back):
        live = np.flatnonzero(g)
        rows_at = padded[at[live] + np.arange(len(kernel))[:, None]]  # (width, live, 2)
        in_filter = np.zeros_like(kernel)
        in_filter[:, :, live] = model.embedding[rows_at].sum(axis=2).transpose(0, 2, 1) * g[live]
        in_filters.append(in_filter)
        at_rows.append(rows_at.ravel())
        in_rows.append(np.repeat((kernel[:, :, live] * g[live]).transpose(0, 2, 1).reshape(-1, kernel.shape[1]), 2, axis=0))
    flat, inverse = np.unique(np.concatenate(at_rows), return_inverse=True)
    summed = np.zeros((len(flat), model.embedding.shape[1]), np.float32)
    np.add.at(summed, inverse, np.concatenate(in_rows))
    summed[flat == 0] = 0  # the zero vector stays
    return Gradients(error, error * pooled, in_filters, back, flat, summed)


class Adagrad:
    def __init__(self, values: np.ndarray, rate: float):
        self.values, self.rate, self.seen = values, rate, np.full(values.shape, 1e-3, np.float32)

    def step(self, grad: np.ndarray, at=slice(None)) -> None:
        self.seen[at] += grad * grad
        self.values[at] -= self.rate * grad / np.sqrt(self.seen[at])


def fit(texts: list[str], labels: list[int], how: Training = Training()) -> Model:
    """Trains on one text at a time with Adagrad; a text's gradient flows through the pooled places only."""
    y = np.asarray(labels)
    if not (y == 1).any() or not (y == 0).any():
        return Model()
    hashed = [np.array([buckets(w) for w in words_of(t)], np.int64).reshape(-1, 2) for t in texts]
    held = np.arange(len(texts)) % how.calibration == how.calibration - 1
    if len(texts) < 8 * how.calibration or len(set(y[held])) < 2:
        held[:] = False
    found, n_texts = np.unique(np.concatenate([np.unique(h) for h, k in zip(hashed, held) if not k] or [np.zeros(0, np.int64)]), return_counts=True)
    known = found[n_texts >= how.min_texts]
    rng = np.random.default_rng(how.seed)
    n_filters = how.filters * len(how.widths)
    model = Model(
        rows={int(b): i + 1 for i, b in enumerate(known)},
        embedding=np.concatenate([np.zeros((1, how.dim)), rng.normal(0, 0.1, (len(known), how.dim))]).astype(np.float32),
        filters=[rng.normal(0, 0.5 / np.sqrt(w), (w, how.dim, how.filters)).astype(np.float32) for w in how.widths],
        bias=[np.zeros(how.filters, np.float32) for _ in how.widths],
        out=rng.normal(0, 0.5, n_filters).astype(np.float32),
        shift=0.0,
    )

    def to_rows(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return np.where(known[at] == h, at + 1, 0) if len(known) else np.zeros(h.shape, np.int64)

    rows = [to_rows(h) for h in hashed]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    shift = np.zeros(1, np.float32)
    steps = {"e": Adagrad(model.embedding, how.rate), "out": Adagrad(model.out, how.rate), "shift": Adagrad(shift, how.rate)}
    kernels = [Adagrad(k, how.rate) for k in model.filters]
    biases = [Adagrad(b, how.rate) for b in model.bias]
    for _ in range(how.epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            grads = gradients(model, rows[i], y[i], weight[i])
            steps["out"].step(grads.out + how.decay * model.out)
            steps["shift"].step(np.array([grads.error], np.float32))
            model.shift = float(shift[0])
            for k, kernel in enumerate(model.filters):
                if grads.bias[k].any():
                    kernels[k].step(grads.filters[k] + how.decay * kernel)
                    biases[k].step(grads.bias[k])
            if len(grads.rows):
                steps["e"].step(grads.embedding, grads.rows)
    calibrate(model, [(language(words_of(t)), model.logit(r), label) for t, r, label, h in zip(texts, rows, y, held) if h or not held.any()])
    return model


def language(words: list[str]) -> int:
    """The index of the likeliest language; the number of languages where no function word occurs."""
    hits = [0] * len(LANGUAGES)
    for w in words:
        for k in _language_of.get(w, ()):
            hits[k] += 1
    return hits.index(max(hits)) if any(hits) else len(LANGUAGES)


_language_of: dict[str, tuple[int, ...]] = {}
for _k, _name in enumerate(LANGUAGES):
    for _w in FUNCTION_WORDS[_name].split():
        _language_of[_w] = (*_language_of.get(_w, ()), _k)


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap between logits among those with the fewest errors."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    gaps = np.diff(edges)
    gaps[1:-1][x[1:] == x[:-1]] = -1  # equal logits can't be parted
    best = np.flatnonzero((errors == errors[gaps >= 0].min()) & (gaps >= 0))
    k = best[gaps[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def calibrate(model: Model, scored: list[tuple[int, float, int]], least: int = 20) -> None:
    """Thresholds by language; that of all languages where either class has fewer than ``least`` texts."""
    lang, logit, label = (np.array(c) for c in zip(*scored))
    model.thresholds[:] = best_threshold(logit, label)
    for k in range(len(LANGUAGES)):
        own = lang == k
        if min((label[own] == 1).sum(), (label[own] == 0).sum()) >= least:
            model.thresholds[k] = best_threshold(logit[own], label[own])


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", how: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the rows of ``labels`` outside the held-out fifth; see ``Training`` for the bounds of the sample."""
    known = labels.where(~held_out(column(id_col)) & column(target).isin(0, 1)).select(column(id_col).alias("id"), column(target).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sized = docs.select(column(id_col).alias("id"), F.length(column(text_col)).alias("n")).where(F.col("n").between(1, how.max_chars)).groupBy("id").agg(F.min("n").alias("n"))
    usable = scratch(known.join(sized, "id"), "labelled")  # ids, labels and lengths; no texts

    def first(y: int, n: int) -> DataFrame:
        return usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)

    sample = first(1, how.n_positive).unionByName(first(0, how.n_negative))
    up_to = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # n_positive + n_negative rows at most
    sample = scratch(sample.withColumn("so_far", F.sum("n").over(up_to)).where(F.col("so_far") <= how.most_chars), "sample")
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").where(F.length("text") == F.col("n")).groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    return fit([r["text"] for r in rows], [r["y"] for r in rows], how)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


class Rows(dict):
    """The embedding rows of a word and its stem, made when first asked for; two generations bound the memory."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most, self.older = model, most, {}

    def __missing__(self, word: str) -> tuple[int, int]:
        row = self.older.get(word)
        if row is None:
            whole, stem = buckets(word)
            row = self.model.rows.get(whole, 0), self.model.rows.get(stem, 0)
        if len(word) > 64:  # rare, and would make the memory unbounded
            return row
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = row
        return row

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.int64, 2 * len(words)).reshape(-1, 2)


def scorer(spark, model: Model):
    """A function from a text column to scores between 0 and 1."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        row_of = Rows(m)
        for texts in batches:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                words = words_of(text)
                z = m.logit(row_of.of(words)) - m.thresholds[language(words)]
                out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.Series(out)

    return F.pandas_udf(scored, "double").asNondeterministic()


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score, predicted."""
    scored = docs.select(column(id_col).alias(id_col), held_out(column(id_col)).alias("held_out"), scorer(docs.sparkSession, model)(column(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with the columns of ``docs``."""
    scored = docs.select(whole_row(docs), scorer(docs.sparkSession, model)(column(text_col)).alias("score"))
    return scored.where(F.col("score") < 0.5).select("row.*")
