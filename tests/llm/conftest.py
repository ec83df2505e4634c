import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    rows = [
        (1, "hello world", "en", "a", 11), (1, "hello world", "en", "a", 11), (2, None, None, None, None), (3, "", "en", None, 0), (4, long, "en", "b", len(long)),
        (None, "no id here but words", "de", "a", 20), (5, " \t\n ", "fr", "c", 4), (6, "héllo wörld ▁ <|endoftext|>   \x1c end", "fr", "c", 30), (7, "x" * 50_000, "en", "c", 50_000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    clash = ["score", "rank", "mix", "rules", "verdict", "ids", "n_tokens", "id", "key", "rep", "labels", "size", "__text", "row", "host", "counts", "failed", "found", "verdict", "kept", "small_key", "copies", "copy", "rate", "target", "source_size",
             "s", "n", "w", "most", "level", "own", "gone", "scan", "back", "held_out", "y", "so_far", "__size", "__source", "__mix", "__rules", "__counts", "__host", "__score", "a`b", "a.b"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
