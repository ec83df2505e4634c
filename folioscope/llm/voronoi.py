"""Exact top-k search by a Voronoi kNN join on integer inner products.

Pivots, a bounded sample of the distinct vectors, divide data and queries into cells; neighbouring query cells make up the
groups.  Summaries per data cell (the k+1 smallest distances to its pivot r, and the largest) bound, for each query q, the
(k+1)-th best inner product from below and the inner product with any data vector at a distance d from its pivot from
above, as  q.r - |q| d  <=  q.x  <=  q.r + |q| d.

So each query has a least distance per data cell from which on a vector can matter to it, and a group the smallest of its
queries'.  A data vector is sent to a group only if its distance reaches that; a query is sent only to the blocks of data
that hold a cell within its reach.  Data blocks are made of neighbouring cells, or are parts of a large cell.  Each pair of
a query group and a data block is solved alone, and the best of the blocks are merged.

Equal vectors are searched once: only the k+1 smallest ids of a vector can be among anyone's best, and they are found by
a rank filter that prunes before the shuffle.  Queries with equal vectors share one search.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part;
rows that repeat an id with the same vector count once; vectors of other lengths are as if filled with zeros; ties go to
the smaller id; with fewer than k other rows all are returned; an empty table gives no rows; other columns are ignored,
whatever their names; vectors of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import scratch

SCALE = 256
PIVOTS = 16, 1024  # at least and at most; between them the square root of the number of vectors
QUERY_BLOCK = 32_768  # queries of a group
DATA_BLOCK = 16_384
CHUNK = 256  # queries whose products with a data block are held at once


def scaled(embedding: str, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: str) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & finite


def matrix(rows, dim: int | None = None) -> np.ndarray:
    """Rows of numbers as one matrix, shorter ones filled with zeros."""
    rows = [np.asarray(r) for r in rows]
    dim = max([len(r) for r in rows], default=0) if dim is None else dim
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles hold them as long as no sum can reach 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def to_cells(pivots: np.ndarray):
    """A function from vectors to their cell, the distance to its pivot, and the norm."""

    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = pivots.astype(np.float64)
        for vectors in batches:
            x = matrix(vectors).astype(np.float64)
            dim = max(x.shape[1], p.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (x, p))
            cell = ((q * q).sum(axis=1) - 2 * x @ q.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "dist": np.linalg.norm(x - q[cell], axis=1), "norm": np.linalg.norm(x, axis=1)})

    return F.pandas_udf(cells, "cell int, dist double, norm double").asNondeterministic()


def hub_order(pivots: np.ndarray) -> list[int]:
    """The cells in an order in which neighbours stand together: by the nearest of a few pivots, then by the distance to it."""
    p = pivots.astype(np.float64)
    hubs = p[: max(1, int(len(p) ** 0.5))]
    far = (p * p).sum(axis=1)[:, None] - 2 * p @ hubs.T + (hubs * hubs).sum(axis=1)
    hub = far.argmin(axis=1)
    return sorted(range(len(p)), key=lambda j: (int(hub[j]), float(far[j, hub[j]]), j))


def in_blocks(order: list[int], size: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first block, number of blocks): small cells share a block of at most ``most`` rows, larger ones have several."""
    blocks, at, free = {}, -1, 0
    for cell in order:
        n = size.get(cell, 0)
        if not n:
            continue
        if n > most:
            parts = -(-n // most)
            blocks[cell] = at + 1, parts
            at, free = at + parts, 0
        else:
            if n > free:
                at, free = at + 1, most
            blocks[cell] = at, 1
            free -= n
    return blocks


def reaches(queries: np.ndarray, pivots: np.ndarray, nearest: dict[int, list[float]], k: int) -> np.ndarray:
    """For each query and cell the least distance to the pivot at which a data vector can be among the query's k + 1 best.

    ``nearest``: per data cell its smallest distances; other cells hold no data.
    """
    q, p = queries.astype(np.float64), pivots.astype(np.float64)
    norm = np.linalg.norm(q, axis=1)
    slack = 1e-9 * (1 + norm * np.linalg.norm(p, axis=1).max(initial=0))
    dots = q @ p.T
    cells = [j for j, ds in nearest.items() for _ in ds]
    low = dots[:, cells] - norm[:, None] * np.array([d for ds in nearest.values() for d in ds])
    if low.shape[1] > k:
        floor = -np.partition(-low, k, axis=1)[:, k] - slack  # the (k+1)-th
    else:
        floor = np.full(len(q), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = (floor[:, None] - dots) / norm[:, None] - (slack / np.maximum(norm, 1e-300))[:, None]
    return np.where(norm[:, None] > 0, least, -np.inf)


def in_cell(cell: str, values: dict[int, float]) -> Column:
    """The value of the row's cell: one of at most ``PIVOTS[1]`` that stand in the plan."""
    return F.element_at(F.array(*(F.lit(float(values.get(j, -1.0))) for j in range(max(values) + 1))), F.col(cell) + 1)


def block_of(cell: str, blocks: dict[int, tuple[int, int]], key: str) -> Column:
    """The row's block: its cell's, or one of its cell's by a hash of ``key``."""
    table = [blocks.get(j, (0, 1)) for j in range(max(blocks) + 1)]
    first, parts = (F.element_at(F.array(*(F.lit(int(t[i])) for t in table)), F.col(cell) + 1) for i in (0, 1))
    return (first + F.pmod(F.xxhash64(key), parts)).cast("int")


def group_reach(pivots: np.ndarray, nearest: dict[int, list[float]], k: int):
    """Per batch of queries (q, v, g): the least distance of each group and data cell."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.array(sorted(nearest), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, pivots_ = same_length(batch.column(1).to_pylist(), pivots)
            least, g = reaches(vectors, pivots_, nearest, k)[:, cells], batch.column(2).to_numpy()
            for one in np.unique(g):
                row = least[g == one].min(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), one, np.int32)), pa.array(cells), pa.array(row)], ["g", "cell", "least"])

    return reached


def query_blocks(pivots: np.ndarray, nearest: dict[int, list[float]], k: int, blocks: dict[int, tuple[int, int]], most: dict[int, float]):
    """A function from queries to the data blocks that hold a cell within reach."""

    def reached(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cells = np.array(sorted(nearest), np.int32)
        farthest = np.array([most[int(j)] for j in cells])
        for vectors in batches:
            q, p = same_length(vectors, pivots)
            near = reaches(q, p, nearest, k)[:, cells] <= farthest
            yield pd.Series([sorted({b for j in cells[row] for first, n in [blocks[int(j)]] for b in range(first, first + n)}) for row in near], dtype=object)

    return F.pandas_udf(reached, "array<int>").asNondeterministic()


def same_length(vectors, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = matrix(vectors)
    dim = max(x.shape[1], pivots.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (x, pivots))


def solve(k: int):
    def best(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "x": [], "score": []}
        if len(queries) and len(data):
            dim = max(map(len, [*queries["v"], *data["v"]]))
            a, b = matrix(queries["v"], dim), matrix(data["v"], dim)
            q_ids, ids = queries["q"].to_numpy(), data["x"].to_numpy()
            for at in range(0, len(a), CHUNK):
                s = products(a[at : at + CHUNK], b)
                cut = np.partition(s, max(0, s.shape[1] - k - 1), axis=1)[:, max(0, s.shape[1] - k - 1)]
                row, col = np.nonzero(s >= cut[:, None])
                score = s[row, col]
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place <= k
                out["q"].append(q_ids[at + row[keep]])
                out["x"].append(ids[col[keep]])
                out["score"].append(score[keep])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return best


def meeting(data: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """Queries (g, block, q, v) and data (g, block, x, v) as they must meet; None where there are no rows on either side."""
    n_data = data.count()
    pivots = data.orderBy(F.xxhash64("v"), "x").limit(max(PIVOTS[0], min(PIVOTS[1], int(n_data**0.5)))).collect()
    if not pivots:
        return None
    p = matrix([r["v"] for r in pivots])
    cell = to_cells(p)
    data = scratch(data.select("x", "v", cell("v").alias("c")).select("x", "v", "c.*"), "cells")
    near = data.select("cell", "dist").withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).where(F.col("n") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in near.select("cell", "dist").collect():  # k + 1 rows per pivot
        nearest.setdefault(r["cell"], []).append(r["dist"])
    sizes = {r["cell"]: (r["n"], r["most"]) for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("most")).collect()}  # a row per pivot
    placed = queries.select("q", "v", cell("v").alias("c")).select("q", "v", "c.cell")
    asked_of = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row per pivot
    if not asked_of:
        return None
    order = hub_order(p)
    groups = in_blocks(order, asked_of, QUERY_BLOCK)
    blocks = in_blocks(order, {j: n for j, (n, _) in sizes.items()}, DATA_BLOCK)

    numbered = scratch(placed.withColumn("g", block_of("cell", groups, "q")), "placed")
    found_reach = numbered.select("q", "v", "g").mapInArrow(group_reach(p, nearest, k), "g int, cell int, least double")
    least = scratch(found_reach.groupBy("g", "cell").agg(F.min("least").alias("least")), "reach")  # groups * pivots rows at most
    sent = data.join(least.where(in_cell("cell", {j: d for j, (_, d) in sizes.items()}) >= F.col("least")), "cell").where(F.col("dist") >= F.col("least"))
    to_data = sent.select("g", block_of("cell", blocks, "x").alias("block"), "x", "v")
    reach = query_blocks(p, nearest, k, blocks, {j: d for j, (_, d) in sizes.items()})
    to_query = numbered.select("g", F.explode(reach("v")).alias("block"), "q", "v")
    return to_query, to_data


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows other than the query's own with the highest inner products."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), scaled(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    same = Window.partitionBy("v")
    few = rows.select("id", "v").withColumn("n", F.dense_rank().over(same.orderBy("id"))).where(F.col("n") <= k + 1).dropDuplicates(["v", "id"])
    few = scratch(few.select("v", "id", "n", F.min("id").over(same).alias("x")), "vectors")
    data = few.where("n = 1").select("x", "v")
    asked = scratch(rows.where("is_query").select("id", "v").distinct().join(data.withColumnRenamed("x", "q"), "v").select(F.col("id").alias("query_id"), "q", "v"), "queries")
    distinct_queries = asked.select("q", "v").dropDuplicates(["q"])

    met = meeting(data, distinct_queries, k)
    if met is None:
        return empty
    to_query, to_data = met
    keys = ("g", "block")
    found = to_query.groupBy(*keys).cogroup(to_data.groupBy(*keys)).applyInPandas(solve(k), "q long, x long, score long")

    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "x"))).where(F.col("n") <= k + 1)
    with_rows = best.select("q", "x", "score").join(few.select("x", "id"), "x")
    best = with_rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    answered = asked.select("query_id", "q").join(best.select("q", "id", "score"), "q").where(F.col("query_id") != F.col("id"))
    ranked = answered.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 50 = 0
),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
select * from ranked where rank <= 5
"""
