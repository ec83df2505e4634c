"""Ranking and routing: dense top-k, BM25, reciprocal rank fusion, balanced retrieval, MMR, caches, budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.vectors import cosine
from folioscope.operators.common import is_small, small, written

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def tokens(text: Column) -> Column:
    """Lower-cased, by white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def dense_scores(rows: DataFrame, queries: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score) and what else is in ``keep``: ``queries`` (query_id, query_vector) are a batch given by the caller,
    which is counted, scored against all rows."""
    return rows.join(small(queries), F.lit(True)).select("query_id", id_col, *keep, cosine(F.col("embedding"), F.col("query_vector")).alias("score"))


#: Questions (with groups, fewer: each group has its own best) and rows that one task compares, and the scores it holds at a time.
QUESTION_BLOCK, GROUPED_BLOCK, ROW_BLOCK, SCORES = 4096, 256, 16_384, 1_000_000

#: Questions whose pools' texts one task takes apart.
POOL_BLOCK = 256


def as_given(df: DataFrame, column: str) -> Column:
    """Vectors of floats as they are, half as wide on their way to the blocks that compute in doubles; all others as doubles."""
    return F.col(column) if dict(df.dtypes)[column] == "array<float>" else F.col(column).cast("array<double>")


def dense_top(rows: DataFrame, queries: DataFrame, k: int, id_col: str, by: str | None = None, floor: float | None = None, meet: str | None = None) -> DataFrame:
    """(query_id, [by,] id, score, rank): the ``k`` rows of highest cosine of each question, or of each question and group, then the floor.

    Questions (query_id, query_vector) and rows (id, [by,] embedding) of any number meet in blocks of bounded size: a task holds a
    block of each and returns its own ``k`` best, of which a window takes the best of all.  Scores are rounded to 12 places, so equal
    vectors tie wherever they are scored, and ties go to the smaller id.  Rows without an id, and vectors that are null, have another
    length than the question or hold a value that is null or not finite, are left out; a zero vector scores 0; null groups are one.

    With ``meet`` questions and rows meet only where that column, which both have, is equal; each of its values has as many blocks
    as its own rows and questions need.  A question with several values has a row for each.
    """
    keep = [by] if by else []
    if meet:
        return met_top(rows, queries, k, id_col, by, floor, meet)
    asked = queries.where("query_id is not null and query_vector is not null").select("query_id", as_given(queries, "query_vector").alias("v"))
    data = rows.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), *keep, as_given(rows, "embedding").alias("v"))
    q_parts, r_parts = (max(1, -(-df.count() // size)) for df, size in ((asked, GROUPED_BLOCK if by else QUESTION_BLOCK), (data, ROW_BLOCK)))
    block = lambda key, parts: F.pmod(F.xxhash64(key, "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked, data = asked.withColumn("qb", block("query_id", q_parts)), data.withColumn("rb", block("id", r_parts))
    asked, data = asked.select("*", every(r_parts).alias("rb")), data.select("*", every(q_parts).alias("qb"))

    best = asked.groupBy("qb", "rb").cogroup(data.groupBy("qb", "rb")).applyInPandas(*block_best(rows, queries, k, id_col, by))
    return top_per(best.withColumnRenamed("id", id_col), ["query_id", *keep], k, id_col, floor)


def met_top(rows: DataFrame, queries: DataFrame, k: int, id_col: str, by: str | None, floor: float | None, meet: str) -> DataFrame:
    """``dense_top`` of questions and rows that are equal in ``meet``."""
    keep = [by] if by else []
    asked = queries.where(F.col("query_id").isNotNull() & F.col("query_vector").isNotNull() & F.col(meet).isNotNull())
    data = rows.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull() & F.col(meet).isNotNull())
    asked = asked.select("query_id", F.col(meet).alias("at"), as_given(queries, "query_vector").alias("v"))
    data = data.select(F.col(id_col).alias("id"), *keep, F.col(meet).alias("at"), as_given(rows, "embedding").alias("v"))
    parts = lambda df, size, name: df.groupBy("at").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = parts(asked, GROUPED_BLOCK if by else QUESTION_BLOCK, "q_parts").join(parts(data, ROW_BLOCK, "r_parts"), "at")
    block = lambda key, n: F.pmod(F.xxhash64(key, "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, "at").withColumn("qb", block("query_id", "q_parts")).select("query_id", "v", "at", "qb", every("r_parts").alias("rb"))
    data = data.join(sizes, "at").withColumn("rb", block("id", "r_parts")).select("id", *keep, "v", "at", "rb", every("q_parts").alias("qb"))
    best = asked.groupBy("at", "qb", "rb").cogroup(data.groupBy("at", "qb", "rb")).applyInPandas(*block_best(rows, queries, k, id_col, by))
    return top_per(best.withColumnRenamed("id", id_col), ["query_id", *keep], k, id_col, floor)


def block_best(rows: DataFrame, queries: DataFrame, k: int, id_col: str, by: str | None) -> tuple[Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], str]:
    """The function of a block of questions and one of rows that gives the block's ``k`` best, and its schema."""
    keep = [by] if by else []

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for length, some in right.groupby(right["v"].map(len)):
            some = some.sort_values("id", kind="stable")
            mine = left[left["v"].map(len) == length]
            if mine.empty:
                continue
            (ids, units, at), (questions, asking, _) = unit_rows(some, "id"), unit_rows(mine, "query_id")
            if not len(ids) or not len(questions):
                continue
            code = pd.factorize(some[by].iloc[at], use_na_sentinel=False)[0] if by else np.zeros(len(ids), int)
            groups = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1])
            step = max(1, SCORES // len(ids))
            for start in range(0, len(questions), step):
                scores = np.round(asking[start : start + step] @ units.T, 12) + 0.0
                for group in groups:
                    here = scores[:, group]
                    least = np.partition(here, -k, axis=1)[:, -k] if len(group) > k else np.full(len(here), -np.inf)
                    q, r = np.nonzero(here >= least[:, None])
                    order = np.lexsort((r, -here[q, r], q))  # ids ascend with r
                    q, r = q[order], r[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, r = q[place < k], r[place < k]
                    part = pd.DataFrame({"query_id": questions[start + q], "id": ids[group[r]], "score": here[q, r]})
                    if by:
                        part[by] = some[by].iloc[at[group[r]]].to_numpy()
                    found.append(part)
        return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns, dtype=object)

    columns = ["query_id", *keep, "id", "score"]
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": rows.schema[id_col].dataType} | ({by: rows.schema[by].dataType} if by else {})
    schema = ", ".join(f"`{c}` {kinds[c].simpleString() if c in kinds else 'double'}" for c in columns)
    return solve, schema


def unit_rows(frame: pd.DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, vectors of length 1 (or 0) and places of the frame's rows whose vector ``v`` is finite throughout."""
    vectors = np.empty((len(frame), len(frame["v"].iloc[0])))
    for i, v in enumerate(frame["v"]):  # all of one length; nulls become not a number
        vectors[i] = v
    at = np.flatnonzero(np.isfinite(vectors).all(axis=1))
    return frame[key].to_numpy()[at], unit(vectors[at]), at


def top_per(scored: DataFrame, by: list[str], k: int, id_col: str, floor: float | None = None) -> DataFrame:
    """The ``k`` best of each group with their rank, ties to the smaller id; then the floor."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), id_col)
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked if floor is None else ranked.where(F.col("score") >= floor)


def bm25(pool: DataFrame, queries: DataFrame, id_col: str = "doc_id", own_pool: bool = False) -> DataFrame:
    """(query_id, id, score) of BM25-Okapi over ``pool``; ``queries``: query_id, query.

    The statistics are the pool's: one for all queries, or with ``own_pool`` that of the query's own rows (``pool`` has a
    query_id).  Negative idf becomes ``EPSILON`` times the mean idf of all terms; a query word counts as often as it stands
    in the query; documents without any query word score 0 and are not returned.

    One shuffle carries the distinct terms of each document, summed on the map side first; a null term among them counts the
    documents and their lengths.  Only the asked terms' occurrences are counted by document.
    """
    by = ["query_id"] if own_pool else []
    words = pool.select(*by, id_col, tokens(F.col("text")).alias("ts"))
    per_term = words.select(*by, F.size("ts").alias("dl"), F.explode(F.array_append(F.array_distinct("ts"), F.lit(None).cast("string"))).alias("term"))
    per_term = per_term.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))
    stats = per_term.where("term is null").select(*by, F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    one = F.broadcast if not own_pool or is_small(queries) else lambda df: df  # a row, or one per query
    raw = per_term.where("term is not null").join(one(stats), by or F.lit(True))
    raw = raw.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*by).agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    few = F.broadcast if is_small(asked) else lambda df: df  # idf has no more rows than ``asked``
    idf = raw.join(few(asked), [*by, "term"]).join(one(mean), by or F.lit(True))
    idf = idf.select("query_id", "term", "times", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    hits = words.select(*by, id_col, F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(few(idf), [*by, "term"])
    tf = hits.groupBy("query_id", id_col, "term", "times", "idf", "dl", "avgdl").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.groupBy("query_id", id_col).agg(F.sum(part).alias("score"))


def retrieve(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id", rerank: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, rank, score): the composed search of (query_id, query, query_vector) over rows (id, text, embedding).

    A pool of max(4k, 10) by cosine per query, BM25 on the query's own pool, fusion of both rankings, and then ``rerank`` (a
    function of (query_id, query, id, text, rank) and k, see ``providers.rerank``) or the first ``k``.
    """
    return fused(dense_top(rows, queries, max(4 * k, 10), id_col), rows, queries, k, id_col, rerank)


def fused(dense: DataFrame, rows: DataFrame, queries: DataFrame, k: int, id_col: str, rerank: Callable[[DataFrame, int], DataFrame] | None) -> DataFrame:
    """A ranked pool (query_id, id, score, rank) fused with BM25 on it, then reranked or cut to ``k``.

    A task holds the terms of ``POOL_BLOCK`` questions' pools, whatever their number.
    """
    n_asked, cores = queries.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_asked // POOL_BLOCK), min(n_asked, cores))
    pool = dense.select("query_id", id_col).join(rows.select(id_col, "text"), id_col).repartition(parts, "query_id")
    sparse = bm25(pool, queries.select("query_id", "query"), id_col, own_pool=True).withColumn("score", F.round("score", 9))
    sparse = sparse.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)))
    lists = dense.withColumn("list", F.lit(0)).unionByName(sparse.withColumn("list", F.lit(1)))
    both = rrf(lists.select("query_id", id_col, "list", "rank"), id_col)
    if rerank is None:
        return both.where(F.col("rank") <= k)
    texts = both.join(pool, ["query_id", id_col]).join(queries.select("query_id", "query"), "query_id")
    best = rerank(texts.select("query_id", "query", F.col(id_col).alias("id"), "text", "rank"), k)
    return best.select("query_id", F.col("id").alias(id_col), F.col("final_rank").alias("rank"), "score")


#: A search over several documents takes so many at most, as they are named; route first where there are more.
MOST_DOCUMENTS = 8


def across_documents(rows: DataFrame, questions: DataFrame, id_col: str = "chunk_id", by: str = "doc_id", rerank: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(query_id, by, id, score, rank): the best chunks of every document that a question (query_id, query, query_vector, scope) names.

    Of ``scope`` (an array of documents) the first ``MOST_DOCUMENTS`` different ones count; each gives four chunks where there are
    one or two, three up to four documents, else two, whatever their scores, of its own pool of max(4k, 10) if ``rerank`` orders
    it.  Documents stand in the order named, their chunks by rank.  Documents without chunks and empty scopes give no row.
    """
    scope = F.slice(F.array_distinct(F.array_compact("scope")), 1, MOST_DOCUMENTS)
    named = questions.withColumn("scope", scope).withColumn("k", F.when(F.size("scope") <= 2, 4).when(F.size("scope") <= 4, 3).otherwise(2))
    each = named.select("query_id", "query_vector", "k", F.posexplode("scope").alias("place", by))
    pool = dense_top(rows, each, 16 if rerank else 4, id_col, by, meet=by)
    placed = pool.join(each.select("query_id", by, "k", "place"), ["query_id", by])
    if rerank is not None:
        both = F.struct("query_id", by)
        texts = placed.where(F.col("rank") <= F.greatest(4 * F.col("k"), F.lit(10))).join(rows.select(id_col, "text"), id_col).join(questions.select("query_id", "query"), "query_id")
        texts = texts.select(both.alias("query_id"), "query", F.col(id_col).alias("id"), "text", "rank", "k", "place")
        parts = [rerank(texts.where(F.col("k") == k), k) for k in (4, 3, 2)]
        best = parts[0].unionByName(parts[1]).unionByName(parts[2])
        placed = best.select("query_id.*", "id", "score", F.col("final_rank").alias("rank"), "k", "place").withColumnRenamed("id", id_col)
    order = Window.partitionBy("query_id").orderBy("place", "own")
    cut = placed.withColumnRenamed("rank", "own").where(F.col("own") <= F.col("k"))
    return cut.withColumn("rank", F.row_number().over(order)).select("query_id", by, id_col, "score", "rank")


def retrieve_scoped(rows: DataFrame, questions: DataFrame, k: int = 5, id_col: str = "chunk_id", by: str = "doc_id", rerank: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score, rank): each question the way its scope asks for: several documents are searched one by one
    (``across_documents``), one by the composed search within it, and without a scope (null) the composed search takes all rows.  An
    empty scope finds nothing."""
    sized = questions.withColumn("scope", F.array_distinct(F.array_compact("scope")))
    several = across_documents(rows, sized.where(F.size("scope") > 1), id_col, by, rerank).drop(by)
    one = sized.where(F.size("scope") == 1).withColumn(by, F.col("scope")[0])
    within = dense_top(rows, one, max(4 * k, 10), id_col, meet=by)
    anywhere = dense_top(rows, sized.where("scope is null"), max(4 * k, 10), id_col)
    whole = fused(within.unionByName(anywhere), rows, questions, k, id_col, rerank)
    return several.unionByName(whole.select(several.columns))


def variant_key(variants: DataFrame) -> Column:
    return F.concat_ws(":", F.col("query_id").cast("string"), F.col("sub_ix").cast("string"))


def multi_query(rows: DataFrame, variants: DataFrame, k: int = 5, id_col: str = "doc_id", rerank: Callable[[DataFrame, int], DataFrame] | None = None, pool: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the ``pool`` best rows of each variant (query_id, sub_ix, query, query_vector) of a question as
    one list, fused with BM25 by the question's first variant, then reranked or cut to ``k``.

    Texts that are equal are one chunk, by the hash of the text; it stands where it was first seen, in the order of variants and
    ranks, under the id it had there.
    """
    keyed = variants.withColumn("key", variant_key(variants))
    found = dense_top(rows, keyed.select(F.col("key").alias("query_id"), "query_vector"), pool, id_col).withColumnRenamed("query_id", "key")
    texts = rows.select(id_col, F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    seen = found.join(keyed.select("key", "query_id", "sub_ix"), "key").join(texts, id_col)
    ranked = merged(first_seen(seen, ["query_id", "content"], ["sub_ix", "rank", id_col]).select("query_id", "sub_ix", "rank", id_col, "score"), [id_col])
    primary = variants.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("sub_ix"))).where("place = 1")
    return fused(ranked.withColumn("score", F.lit(None).cast("double")), rows, primary.select("query_id", "query"), k, id_col, rerank)


def with_original(rows: DataFrame, questions: DataFrame, variants: DataFrame, k: int, id_col: str, floor: float) -> DataFrame:
    """(query_id, id, rank, original): what a question's sub-queries (query_id, sub_ix, query_vector) find above the floor, each row
    where it was first seen; a question whose sub-queries find nothing, or that has none, is asked as it is (query_id, query_vector)."""
    keyed = variants.withColumn("key", variant_key(variants))
    found = dense_top(rows, keyed.select(F.col("key").alias("query_id"), "query_vector"), k, id_col, floor=floor).withColumnRenamed("query_id", "key")
    parts = written(merged(found.join(keyed.select("key", "query_id", "sub_ix"), "key").select("query_id", "sub_ix", "rank", id_col), [id_col]), "parts")
    again = questions.join(parts.select("query_id").distinct(), "query_id", "left_anti")
    plain = dense_top(rows, again, k, id_col, floor=floor).select("query_id", id_col, "rank", F.lit(True).alias("original"))
    return parts.select("query_id", id_col, "rank", F.lit(False).alias("original")).unionByName(plain)


def united(lists: DataFrame, id_col: str, k: int, both: bool = True) -> DataFrame:
    """Text and table results (query_id, sub_ix, rank, id, score) of each query as one list: a chunk where it was first seen,
    ``k`` of them, or 2k where both kinds were searched."""
    first = lists.groupBy("query_id", id_col).agg(F.min(F.struct("sub_ix", "rank")).alias("seen"), F.max("score").alias("score"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seen", id_col)))
    return placed.where(F.col("rank") <= (2 * k if both else k)).drop("seen")


def fallback_answer(ranked: DataFrame, most: int = 600) -> DataFrame:
    """(query_id, answer) when nothing can write one: the start of the best chunk's text on one line."""
    first = ranked.where("rank = 1")
    return first.select("query_id", F.regexp_replace(F.substring("text", 1, most), "\n", " ").alias("answer"))


def rrf(lists: DataFrame, id_col: str, k: int = RRF_K) -> DataFrame:
    """Fuses (query_id, id, list, rank), ranks from 1; ties go to the list, then the rank, that was first."""
    fused = lists.groupBy("query_id", id_col).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("__first"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "__first", id_col)
    return fused.withColumn("rank", F.row_number().over(best)).drop("__first")


def per_document_k(n_docs: int) -> int:
    return 4 if n_docs <= 2 else 3 if n_docs <= 4 else 2


def keyword_score(query: Column, text: Column) -> Column:
    """Distinct query words found, as a share."""
    asked = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))), F.size(asked)), F.lit(0.0))


def routed(docs: DataFrame, query_vector: Column, query: Column) -> DataFrame:
    """``route_score``: cosine with the topic vector, else keywords in the summary, else in the file name."""
    words = F.coalesce(keyword_score(query, F.nullif(F.trim("summary"), F.lit(""))), keyword_score(query, F.regexp_replace("filename", r"[^A-Za-z0-9]+", " ")))
    named = F.when(F.coalesce(F.trim("summary"), F.lit("")) == "", keyword_score(query, F.regexp_replace("filename", r"[^A-Za-z0-9]+", " "))).otherwise(words)
    return docs.withColumn("route_score", F.when(F.col("topic").isNotNull(), cosine(F.col("topic"), query_vector)).otherwise(named))


def keyword_relevance(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, relevance): the share of each question's (query_id, query) distinct words that a document (id, text) holds, for
    the ``most`` best documents and what ties with nothing: documents without any of the words fill up, by id.

    Documents meet the different sets of words by words; no pair without a common word is made, but for those that fill up.
    """
    # questions of the same words find the same: each set of words is looked up once, and only its ``most`` best meet the questions
    words = F.coalesce(F.array_join(F.array_sort(F.array_distinct(tokens(F.col("query")))), " "), F.lit(""))
    asked = queries.select("query_id", words.alias("words"))
    sets = asked.select("words").distinct()
    each = F.split("words", " ")
    per_word = sets.where("words <> ''").select("words", F.size(each).alias("n"), F.explode(each).alias("word"))
    held = docs.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    hits = held.join(small(per_word), "word").groupBy("words", "id").agg((F.count("*") / F.first("n")).alias("relevance"))
    best = F.row_number().over(Window.partitionBy("words").orderBy(F.desc("relevance"), "id"))
    hits = hits.withColumn("place", best).where(F.col("place") <= most).drop("place")
    # 2 * most ids hold as many without a common word, or the question has ``most`` with one
    few = docs.select("id").distinct().orderBy("id").limit(2 * most)
    rest = small(few).join(sets, F.lit(True)).join(hits.select("words", "id"), ["words", "id"], "left_anti")
    found = hits.unionByName(rest.select("words", "id", F.lit(0.0).alias("relevance"))).withColumn("place", best).where(F.col("place") <= most)
    return asked.join(found, "words").select("query_id", "id", "relevance")


def route(docs: DataFrame, queries: DataFrame, k: int = 12, weight: float = 0.7, ahead: int = 96) -> DataFrame:
    """(query_id, id, rank, relevance): the ``k`` documents (id, topic, summary, filename) that each question (query_id, query,
    query_vector) goes to: by the cosine with the topic vector, else by the question's words in the summary, else in the file name,
    chosen so that they differ.  Narrow ``docs`` first (``scope.narrowed``)."""
    topics = docs.where("topic is not null").select("id", F.col("topic").alias("embedding"))
    words = docs.where("topic is null").select("id", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.regexp_replace("filename", r"[^A-Za-z0-9]+", " ")).alias("text"))
    return diverse_top(topics, queries, k, weight, "id", ahead, keyword_relevance(words, queries, ahead + 1 + k))


def mmr_order(ids: np.ndarray, relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[tuple[int, float]]:
    """Greedy choice by weight x relevance - (1 - weight) x largest similarity to what is chosen; the first of equals wins."""
    order = np.lexsort((ids, -relevance))
    ids, relevance, vectors = ids[order], relevance[order], vectors[order]
    if len(ids) <= k:
        return list(zip(ids.tolist(), relevance.tolist()))
    size = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(size == 0, 1, size)[:, None]
    chosen, nearest, free = [0], unit @ unit[0], np.ones(len(ids), bool)
    free[0] = False
    while len(chosen) < k:
        value = np.where(free, weight * relevance - (1 - weight) * nearest, -np.inf)
        best = int(value.argmax())
        chosen.append(best)
        free[best] = False
        nearest = np.maximum(nearest, unit @ unit[best])
    return [(int(ids[i]), float(relevance[i])) for i in chosen]


def mmr(candidates: DataFrame, k: int = 12, weight: float = 0.7) -> DataFrame:
    """(query_id, id, rank, relevance) from all candidates (query_id, id, relevance, embedding), chosen as by ``mmr_order``.

    Each of the ``k`` steps is a scan in which tasks find the best candidate of each query among theirs; the driver holds
    the ``k`` chosen vectors of each query, which tell how near a candidate is to what is chosen.
    """
    spark, pool = candidates.sparkSession, candidates.where("query_id is not null and id is not null and relevance is not null and embedding is not null").persist(StorageLevel.MEMORY_AND_DISK)
    chosen: dict[int, list] = {}

    def step():
        shared = spark.sparkContext.broadcast({query: ({r["id"] for r in rows}, [unit(np.asarray([r["embedding"]], np.float64)) for r in rows]) for query, rows in chosen.items()})

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, tuple] = {}
            for batch in batches:
                for query, rows in batch.groupby("query_id"):
                    taken, vectors = shared.value.get(query, ((), ()))
                    rows = rows[~rows["id"].isin(taken)]
                    if rows.empty:
                        continue
                    ids, relevance = rows["id"].to_numpy(), rows["relevance"].to_numpy()
                    value = weight * relevance
                    if vectors:
                        units = unit(np.stack([np.asarray(v, np.float64) for v in rows["embedding"]]))
                        # row by row, so that equal vectors have equal values wherever they are
                        value = value - (1 - weight) * np.max([(units * v).sum(axis=1) for v in vectors], axis=0)
                    i = np.lexsort((ids, -relevance, -value))[0]
                    mine = (value[i], relevance[i], -ids[i], rows["embedding"].iloc[i])
                    if query not in found or mine[:3] > found[query][:3]:
                        found[query] = mine
            yield pd.DataFrame([(query, *f) for query, f in found.items()], columns=["query_id", "value", "relevance", "id", "embedding"])

        parts = pool.mapInPandas(best, "query_id long, value double, relevance double, id long, embedding array<double>")
        rows = parts.groupBy("query_id").agg(F.max(F.struct("value", "relevance", "id", "embedding")).alias("b")).collect()
        shared.destroy()
        return rows

    try:
        for _ in range(k + 1):  # the last step tells which queries have more candidates than ``k``
            found = step()
            for r in found:
                chosen.setdefault(r.query_id, []).append({"id": -r.b.id, "relevance": r.b.relevance, "embedding": r.b.embedding})
            if not found:
                break
    finally:
        pool.unpersist()
    out = []
    for query, rows in chosen.items():
        if len(rows) <= k:
            rows.sort(key=lambda r: (-r["relevance"], r["id"]))
        out += [(query, r["id"], n, r["relevance"]) for n, r in enumerate(rows[:k], 1)]
    return spark.createDataFrame(out, "query_id long, id long, rank int, relevance double")


def diverse_top(rows: DataFrame, queries: DataFrame, k: int = 12, weight: float = 0.7, id_col: str = "id", ahead: int = 96, rated: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank, relevance): for each question (query_id, query_vector) ``k`` of the rows (id, embedding), chosen one by
    one by ``weight`` x cosine - (1 - ``weight``) x largest cosine with what is chosen; the more relevant of equals wins, then the
    smaller id.  Where there are no more than ``k`` rows they are ranked by relevance.

    Lazy greedy in turns.  Values only fall as more is chosen, so in each turn every pair of a block of questions and a block of
    rows gives its ``ahead`` + 1 best as of now, and the best of all are taken one after the other as long as the next is not
    behind the last of them, which bounds all that was not sent.  A turn chooses one row at least, and mostly all of them; what
    is chosen is a table, and questions that have their rows drop out.

    ``rated`` (query_id, id, relevance): rows without a vector, which are like nothing that is chosen.

    What a block offers are ids and values; the vectors of the ``ahead`` + 1 best of all are joined to them.

    Rows and questions without an id, and vectors that are null, of another length, or not finite take no part; repeated rows
    count once; a zero vector has the relevance 0.
    """
    asked = queries.where("query_id is not null and query_vector is not null").select("query_id", F.col("query_vector").cast("array<double>").alias("v")).dropDuplicates(["query_id"])
    data = rows.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), as_given(rows, "embedding").alias("v")).dropDuplicates(["id"])
    ahead = max(ahead, k)  # so that the first turn tells whether there are more than k rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    r_parts = max(1, -(-data.count() // ROW_BLOCK))
    n_asked = asked.count()
    q_parts = max(1, -(-n_asked // QUESTION_BLOCK), min(n_asked, cores // r_parts))
    block = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    to_rows = data.withColumn("rb", block("id", r_parts)).select("*", every(q_parts).alias("qb"))
    asked = asked.withColumn("qb", block("query_id", q_parts)).withColumns({"ids": F.array().cast(f"array<{dict(data.dtypes)['id']}>"), "chosen": F.array().cast("array<double>"), "relevances": F.array().cast("array<double>"), "open": F.lit(True)})
    kind = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(data.dtypes)['id']}, relevance double, value double"
    state = f"query_id {dict(asked.dtypes)['query_id']}, v array<double>, qb int, ids array<{dict(data.dtypes)['id']}>, chosen array<double>, relevances array<double>, open boolean"

    def offered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, some in right.groupby(right["v"].map(len)):
            mine = left[left["v"].map(len) == length]
            if mine.empty:
                continue
            ids, units, _ = unit_rows(some.sort_values("id", kind="stable"), "id")
            questions, asking, of = unit_rows(mine, "query_id")
            for q, ask, i in zip(questions, asking, of):
                relevance = np.round(units @ ask, 12) + 0.0
                value = weight * relevance
                if len(mine["chosen"].iloc[i]):
                    value = value - (1 - weight) * np.round(units @ unit(np.reshape(mine["chosen"].iloc[i], (-1, length))).T, 12).max(axis=1)
                value = np.round(value, 12)
                if len(mine["ids"].iloc[i]):
                    value = np.where(np.isin(ids, mine["ids"].iloc[i]), -np.inf, value)
                near = np.arange(len(ids)) if len(ids) <= ahead + 1 else np.flatnonzero(value >= np.partition(value, -(ahead + 1))[-(ahead + 1)])
                near = near[np.lexsort((near, -relevance[near], -value[near]))][: ahead + 1]  # ids ascend with the place
                near = near[value[near] > -np.inf]
                out.append((np.full(len(near), q), ids[near], relevance[near], value[near]))
        columns = ["query_id", "id", "relevance", "value"]
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out))))) if out else pd.DataFrame(columns=columns, dtype=object)

    def choose(questions: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        question = questions.iloc[0]
        ids, relevances = list(question["ids"]), list(question["relevances"])
        chosen = list(np.reshape(question["chosen"], (-1, len(question["v"]))))  # a row's vectors stand one after the other
        found = found.sort_values(["value", "relevance", "id"], ascending=[False, False, True]).reset_index(drop=True)
        has = found["v"].notna().to_numpy()
        whole = len(found) <= ahead
        if len(found):
            last = found.iloc[-1]
            units = np.zeros((len(found), len(question["v"])))
            if has.any():
                units[has] = unit(np.stack([np.asarray(v, np.float64) for v in found["v"][has]]))
            nearest = np.full(len(found), -np.inf)
            if chosen:
                nearest = np.round(units @ unit(np.array(chosen, np.float64)).T, 12).max(axis=1)
            free = np.ones(len(found), bool)
            relevance, own = found["relevance"].to_numpy(), found["id"].to_numpy()
            if whole and not ids and len(found) <= k:
                order = np.lexsort((own, -relevance))
                ids, relevances = own[order].tolist(), relevance[order].tolist()
                free[:] = False
            while free.any() and len(ids) < k:
                value = np.round(weight * relevance - (1 - weight) * np.where(has & ~np.isinf(nearest), nearest, 0), 12)
                open_ = np.flatnonzero(free)
                i = open_[np.lexsort((own[open_], -relevance[open_], -value[open_]))[0]]
                if not whole and (-value[i], -relevance[i], own[i]) > (-last["value"], -last["relevance"], last["id"]):
                    break
                ids.append(own[i])
                relevances.append(float(relevance[i]))
                free[i] = False
                if has[i]:
                    chosen.append(found["v"].iloc[i])
                    nearest = np.maximum(nearest, np.round(units @ units[i], 12))
        chosen = np.concatenate([np.asarray(c, np.float64) for c in chosen]).tolist() if chosen else []
        return pd.DataFrame([(question["query_id"], question["v"], question["qb"], ids, chosen, relevances, len(ids) < k and not whole)], columns=["query_id", "v", "qb", "ids", "chosen", "relevances", "open"])

    done = None
    if rated is not None:
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id"))
        rated = rated.where("query_id is not null and id is not null and relevance is not null").dropDuplicates(["query_id", "id"]).withColumn("place", first).where(F.col("place") <= ahead + 1 + k).drop("place")
        rated = written(rated, "rated")
    for _ in range(k):
        now = asked.select("*", every(r_parts).alias("rb"))
        offers = now.groupBy("qb", "rb").cogroup(to_rows.groupBy("qb", "rb")).applyInPandas(offered, kind).withColumn("of", F.col("id"))
        if rated is not None:
            left = rated.join(asked.select("query_id", "ids"), "query_id").where(~F.array_contains("ids", F.col("id")))
            left = left.select("query_id", "id", "relevance", F.round(weight * F.col("relevance"), 12).alias("value"), F.lit(None).cast(data.schema["id"].dataType).alias("of"))
            offers = offers.unionByName(left)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), F.desc("relevance"), "id"))
        offers = offers.withColumn("place", best).where(F.col("place") <= ahead + 1).drop("place")
        offers = offers.join(data.withColumnRenamed("id", "of"), "of", "left").drop("of")  # only what may be chosen takes its vector along
        asked = written(asked.groupBy("query_id").cogroup(offers.groupBy("query_id")).applyInPandas(choose, state), "choices")
        done = asked.where(~F.col("open")) if done is None else done.unionByName(asked.where(~F.col("open")))
        asked = asked.where("open")
        if asked.isEmpty():
            break
    taken = done.select("query_id", F.posexplode(F.arrays_zip("ids", "relevances")).alias("at", "x"))
    return taken.select("query_id", F.col("x.ids").alias(id_col), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.relevances").alias("relevance"))


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(size == 0, 1, size)[:, None]


def exact_key(query: Column) -> Column:
    return F.sha2(F.trim(F.lower(query)), 256)


def nearest_entries(asked: DataFrame, entries: list, threshold: float) -> DataFrame:
    """(query_id, near_id, score) of each asked (query_id, query_vector) that some entry (entry_id, embedding) of a bounded list is
    similar enough to; scores within 1e-12 are equal, and the smallest id of equals wins.  Vectors meet those of their own length;
    what is null or not finite takes no part."""
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, near_id long, score double"
    if not entries:
        return asked.sparkSession.createDataFrame([], kind)
    by_length: dict[int, list] = {}
    for r in sorted(entries, key=lambda r: r["entry_id"]):
        v = np.asarray(r["embedding"], np.float64)
        if len(v) and np.isfinite(v).all():
            by_length.setdefault(len(v), []).append((r["entry_id"], v))
    kept = {n: (np.array([i for i, _ in rows], np.int64), unit(np.stack([v for _, v in rows]))) for n, rows in by_length.items()}
    shared = asked.sparkSession.sparkContext.broadcast(kept)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, same in batch.groupby(batch["query_vector"].map(len)):
                if length not in shared.value:
                    continue
                ids, units = shared.value[length]
                for at in range(0, len(same), 1024):
                    part = same.iloc[at : at + 1024]
                    questions, asking, _ = unit_rows(part.rename(columns={"query_vector": "v"}), "query_id")
                    if not len(questions):
                        continue
                    scores = asking @ units.T
                    best = (scores >= scores.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
                    found = pd.DataFrame({"query_id": questions, "near_id": ids[best], "score": scores[np.arange(len(questions)), best]})
                    yield found[found["score"] >= threshold]

    return asked.where("query_vector is not null").select("query_id", "query_vector").mapInPandas(nearest, kind)


def cache_lookup(asked: DataFrame, entries: DataFrame, threshold: float = 0.85, most: int = 2000) -> DataFrame:
    """Per asked (query_id, query, query_vector) the cache entry (entry_id, query, embedding, cached_at) that answers it.

    The exact tier joins on the hash of the trimmed lower-case text; the semantic tier takes the most similar of the
    ``most`` latest entries that have a vector, if it reaches the threshold.
    """
    keyed = entries.select("entry_id", exact_key(F.col("query")).alias("__key"))
    exact = asked.withColumn("__key", exact_key(F.col("query"))).join(keyed, "__key").groupBy("query_id").agg(F.min("entry_id").alias("exact_id"))
    latest = entries.where("embedding is not null").orderBy(F.desc("cached_at"), "entry_id").limit(most).select("entry_id", "embedding")
    near = nearest_entries(asked, latest.collect(), threshold)  # at most ``most`` rows
    found = asked.select("query_id").join(exact, "query_id", "left").join(near, "query_id", "left")
    tier = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "semantic").otherwise("miss")
    return found.select("query_id", tier.alias("tier"), F.coalesce("exact_id", "near_id").alias("entry_id"), F.when(F.col("exact_id").isNull(), F.col("score")).alias("score"))


def grade(scores: DataFrame, by: str, strong: float = 0.55, gap: float = 0.10, groups: DataFrame | None = None) -> DataFrame:
    """Per group: weak or strong by the best score and its lead over the upper median; strong where rows have no scores; empty
    for those of ``groups`` (one column ``by``) that found nothing.  Groups are the few best rows of a search."""
    kept = scores.groupBy(by).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"), F.count("*").alias("n"))
    if groups is not None:
        kept = groups.select(by).distinct().join(kept, by, "left").withColumns({"s": F.coalesce("s", F.array().cast("array<double>")), "n": F.coalesce("n", F.lit(0))})
    top, median = F.try_element_at("s", F.lit(1)), F.try_element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int"))
    verdict = F.when(F.col("n") == 0, "empty").when(F.size("s") == 0, "strong").when(top < strong, "weak").when(F.size("s") == 1, "strong").when(top - median >= gap, "strong").otherwise("weak")
    above = F.when(F.size("s") == 0, F.col("n")).otherwise(F.size(F.filter("s", lambda x: x >= strong)).cast("long"))
    return kept.select(by, verdict.alias("grade"), F.round(top, 4).alias("top_score"), above.alias("above_threshold"))


def broadened(query: Column) -> Column:
    """Without a trailing parenthesis, else without what follows the first preposition; null if neither shortens it."""
    bare = F.trim(F.regexp_replace(query, r"\s*\([^)]*\)\s*$", ""))
    cut = F.trim(F.regexp_replace(query, r"(?i)\s+(in|for|of|during|at|under|within|between)\s+\S.*$", ""))
    return F.when((bare != "") & (bare != query), bare).when((cut != "") & (cut != query), cut)


def budget_prefix(chunks: DataFrame, by: str, order: str, budget: int = 12_000) -> DataFrame:
    """The longest prefix of each group within the token budget (a token is four characters), one chunk at least."""
    here = Window.partitionBy(by).orderBy(order)
    counted = chunks.withColumn("tokens", F.floor(F.length("text") / 4)).withColumn("used", F.sum("tokens").over(here)).withColumn("__n", F.row_number().over(here))
    return counted.where((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def history(messages: DataFrame, last: int = 6, most_chars: int = 500, budget: int = 2000) -> DataFrame:
    """The latest messages of each conversation, cut to ``most_chars``, the oldest dropped until the budget holds."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= last).withColumn("text", F.substring("text", 1, most_chars))
    used = F.sum(F.floor(F.length("text") / 4)).over(back)
    return recent.withColumn("used", used).where((F.col("used") <= budget) | (F.col("__n") == 1)).select("conv_id", "turn", "role", "text", "used")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def merged(lists: DataFrame, key: list[str], by: str = "query_id") -> DataFrame:
    """Rankings of several sub-queries (query_id, sub_ix, rank, key) as one list: each key where it was first seen, renumbered."""
    first = lists.groupBy(by, *key).agg(F.min(F.struct("sub_ix", "rank")).alias("__first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("__first", *key))).drop("__first")


def survey(scored: DataFrame, k: int = 8) -> DataFrame:
    """Per query and document the evidence count among the ``k`` best chunks and the best score, most evidence first."""
    best = top_per(scored, ["query_id", "doc"], k, "chunk")
    per = best.groupBy("query_id", "doc").agg(F.count("*").alias("evidence"), F.max("score").alias("score"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("evidence"), F.desc("score"), "doc")))


def resolved_scope(docs: DataFrame, routed: DataFrame, most: int = 8) -> DataFrame:
    """The documents to search: all where there are ``most`` at most, else the routed ones, else all."""
    counts = docs.agg(F.count("*").alias("__n")).join(F.broadcast(routed.agg(F.count("*").alias("__r"))))  # two scalars
    chosen = docs.join(routed.select("doc_id").distinct().withColumn("__routed", F.lit(True)), "doc_id", "left").join(F.broadcast(counts))
    return chosen.where((F.col("__n") <= most) | (F.col("__r") == 0) | F.coalesce("__routed", F.lit(False))).drop("__n", "__r", "__routed")


def numbered_sources(ranked: DataFrame) -> DataFrame:
    """A source list per query in rank order, numbered from 1."""
    return ranked.withColumn("source_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
