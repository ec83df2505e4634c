"""The corpus pipeline: toxic documents go, then those that fail the quality rules, then near duplicates; what is left is
mixed to target weights and encoded with merge-dropout.

Null and empty texts are kept by the first stage, fail the quality rules, and so never reach the later ones, which would treat
them as texts without words; an empty table gives an empty table at every stage; repeated rows and rows without an id are
rows like others; texts of any length are read whole; columns that the stages do not know pass through all but the last,
whatever their names.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``docs``.  ``run`` writes each stage's result to the shared folder as Parquet and reads it back as
the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import host_rules, mixing, near_dup, piece_dropout, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents and keeps those that score below 0.5: all of them where labels are of one class or none."""
    model = toxicity.train(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and whose host is not rejected; texts without words fail, null hosts are one host."""
    return host_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates, every row of it, and rows with a null id."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits documents as often as their source's repetition rate says; repeated rows with one id are emitted equally often."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and ids of each document; ids is null and n_pieces 0 where the text is null."""
    encoded = piece_dropout.encode_docs(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: A trained classifier is the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
