"""What models do elsewhere is injected here: embedders, scorers, judges.  The defaults are deterministic and need no model.

A provider is a function of a pandas Series (or two) to a Series; ``embed``, ``rerank`` and ``verify`` put it into a plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def hashed_embedding(texts: pd.Series, dim: int = 64) -> pd.Series:
    """Signed counts of hashed words, normalised."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(dim)
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 32 & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return texts.map(one)


def word_overlap(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """The share of the question's words that the text has."""

    def one(q: str | None, t: str | None) -> float:
        asked, found = set((q or "").lower().split()), set((t or "").lower().split())
        return len(asked & found) / len(asked) if asked else 0.0

    return pd.Series([one(q, t) for q, t in zip(questions, texts)], dtype="float64")


def embed(text: Column, provider: Callable[[pd.Series], pd.Series] = hashed_embedding) -> Column:
    return F.pandas_udf(lambda s: provider(s), "array<double>", F.PandasUDFType.SCALAR)(text)


def score(question: Column, text: Column, provider: Scorer = word_overlap) -> Column:
    return F.pandas_udf(lambda q, t: provider(q, t), "double", F.PandasUDFType.SCALAR)(question, text)


def rerank(pool: DataFrame, k: int, provider: Scorer = word_overlap) -> DataFrame:
    """The ``k`` best of each question (query_id, query, id, text, rank) by the scorer, ties in the order given; a pool of ``k``
    rows or fewer keeps its order."""
    sized = pool.withColumn("__n", F.count("*").over(Window.partitionBy("query_id"))).withColumn("score", score(F.col("query"), F.col("text"), provider))
    better = F.when(F.col("__n") > k, F.col("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(better), "rank")
    return sized.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).drop("__n")


def verify(claims: DataFrame, threshold: float = 0.5, provider: Scorer = word_overlap) -> DataFrame:
    """``support`` of each claim by its evidence and whether it is verified; what the scorer can't judge has 0.5 and is not verified."""
    given = score(F.col("claim"), F.col("evidence"), provider)
    judged = claims.withColumn("__s", F.when(F.coalesce(F.trim("evidence"), F.lit("")) != "", given))
    return judged.withColumn("support", F.coalesce("__s", F.lit(0.5))).withColumn("verified", F.coalesce(F.col("__s") >= threshold, F.lit(False))).drop("__s")
