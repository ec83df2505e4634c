"""Hard negatives by norm-bucketed search: for an anchor and each of its nearest rows of the same label, the nearest rows of
other labels whose score stands in a window below that of the positive.

Candidates are sorted by norm into buckets of bounded size, the longest first.  By Cauchy-Schwarz no score of a bucket is above
the anchor's norm times the bucket's largest; a bucket is left out where that stays below the lower limit of each of the anchor's
windows, or below the ``k``-th best score that a window has so far.  Since the bound falls from bucket to bucket, an anchor
needs a prefix of them.  They are searched in waves, each ``GROWTH`` times as many buckets as the one before: within a wave
blocks of anchors and buckets meet in tasks of their own, and between waves the running ``k``-th scores are carried over, so that
anchors drop out.  Positives are such a search too, with one window without limits.

Anchors with equal vector and label share one search, and windows with equal limits are searched once.  Of rows with equal vector
and label only the ``k`` + 1 smallest ids can be among anyone's best; they are found by a rank filter, which prunes before the
shuffle, so that a vector that a third of all rows share is no group of its own.

Defined results: rows with a null id, a null label, or a vector that is null or holds a null or non-finite component take no
part; of rows that repeat an id one counts, that with the smallest label and then vector; vectors of other lengths are as if
filled with zeros; ties go to the smaller id; with fewer rows than asked for all are returned; anchors without positives, and
positives without negatives in their window, give no rows; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import scratch
from folioscope.llm.voronoi import matrix, products, scaled, usable

SCALE = 256
BUCKET, MOST_BUCKETS = 4096, 65_536  # rows of a bucket, unless that makes too many
ANCHOR_BLOCK = 4096
GROWTH = 8
CHUNK = 256  # anchors whose scores with a bucket are held at once
LEAST, MOST = -(1 << 62), 1 << 62  # a window without limits

FOUND = "a long, lo long, hi long, id long, score long"


def best_in_windows(k: int, same_label: bool):
    """A function that solves one block of anchors (a, v, label, windows) with one bucket (id, v, label)."""

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(rows):
            rows = rows.sort_values("id", kind="stable")
            dim = max(map(len, [*asked["v"], *rows["v"]]))
            left, right = matrix(asked["v"], dim), matrix(rows["v"], dim)
            names, ids = asked["a"].to_numpy(), rows["id"].to_numpy()
            label, labels = asked["label"].to_numpy(), rows["label"].to_numpy()
            windows = [[(w["lo"], w["hi"], w["floor"]) for w in ws] for ws in asked["windows"]]
            for start in range(0, len(left), CHUNK):
                scores = products(left[start : start + CHUNK], right)
                other = (label[start : start + CHUNK, None] == labels) != same_label
                for j in range(max(map(len, windows[start : start + CHUNK]))):
                    at = np.array([i for i, ws in enumerate(windows[start : start + CHUNK]) if len(ws) > j])
                    lo, hi, floor = np.array([windows[start + i][j] for i in at], np.int64).T
                    here = np.where(other[at] | (scores[at] < floor[:, None]) | (scores[at] > hi[:, None]), LEAST, scores[at])
                    cut = np.partition(here, -k, axis=1)[:, -k] if here.shape[1] > k else np.full(len(here), LEAST)
                    q, r = np.nonzero((here >= cut[:, None]) & (here > LEAST))
                    order = np.lexsort((r, -here[q, r], q))  # ids ascend with r
                    q, r = q[order], r[order]
                    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                    q, r = q[keep], r[keep]
                    out.append((names[start + at[q]], lo[q], hi[q], ids[r], here[q, r]))
        columns = ("a", "lo", "hi", "id", "score")
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i, c in enumerate(columns)})

    return best


def in_buckets(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """The rows (id, label, v, norm) with their bucket, numbered from the longest vectors on, and each bucket's largest norm."""
    n = rows.count()
    buckets = max(1, -(-n // max(BUCKET, -(-n // MOST_BUCKETS))))
    sorted_ = rows.repartitionByRange(buckets, F.desc("norm"), "id").withColumn("bucket", F.spark_partition_id())
    sorted_ = scratch(sorted_, "buckets")
    largest = {r["bucket"]: r["most"] for r in sorted_.groupBy("bucket").agg(F.max("norm").alias("most")).collect()}  # MOST_BUCKETS rows at most
    bound, bounds = 0.0, []
    for b in range(max(largest, default=-1), -1, -1):  # an empty bucket has the bound of the next
        bound = max(bound, largest.get(b, 0.0))
        bounds.append(bound)
    return sorted_, bounds[::-1]


def reach(bounds: list[float]):
    """The last bucket that can hold a score of at least one of the floors, by norm; -1 where none can."""
    bound = np.array(bounds)

    @F.pandas_udf("int")
    def last(norm: pd.Series, floor: pd.Series) -> pd.Series:
        # |a| * bound >= floor, with room for rounding; bounds do not rise
        with np.errstate(over="ignore"):
            least = (floor.to_numpy() - 1) / np.maximum(norm.to_numpy(), 1e-300) * (1 - 1e-9)
        return pd.Series((np.searchsorted(-bound, -least, side="right") - 1).astype(np.int32))

    return last


def search(asked: DataFrame, windows: DataFrame, rows: DataFrame, bounds: list[float], k: int, same_label: bool) -> DataFrame:
    """(a, lo, hi, id, score, rank): the ``k`` best rows of each of ``windows`` (a, lo, hi), which belong to ``asked`` (a, label, v, norm)."""
    window, last = ["a", "lo", "hi"], reach(bounds)
    best = Window.partitionBy(*window).orderBy(F.desc("score"), "id")
    found = None
    first, size = 0, 1
    while first < len(bounds):
        end = min(first + size, len(bounds))
        floors = windows.withColumn("floor", F.col("lo"))
        if found is not None:
            full = found.groupBy(*window).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
            floors = windows.join(full, window, "left").withColumn("floor", F.greatest("lo", F.coalesce("kth", "lo")))
        held = floors.groupBy("a").agg(F.collect_list(F.struct("lo", "hi", "floor")).alias("windows"), F.min("floor").alias("least"))  # a few per anchor
        now = asked.join(held, "a").withColumn("last", F.least(last("norm", F.col("least").cast("double")), F.lit(end - 1)))
        now = scratch(now.where(F.col("last") >= first), "asked")
        blocks = -(-now.count() // ANCHOR_BLOCK)
        if not blocks:  # no bucket that follows can hold anything, as their bounds are lower still
            break
        now = now.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
        to_asked = now.select("block", F.explode(F.sequence(F.lit(first), F.col("last"))).alias("bucket"), "a", "v", "label", "windows")
        meet = now.groupBy("block").agg(F.max("last").alias("last")).select(F.col("block").alias("to"), F.explode(F.sequence(F.lit(first), F.col("last"))).alias("at"))
        to_rows = rows.join(meet, F.col("bucket") == F.col("at")).select(F.col("to").alias("block"), "bucket", "id", "label", "v")
        new = to_asked.groupBy("block", "bucket").cogroup(to_rows.groupBy("block", "bucket")).applyInPandas(best_in_windows(k, same_label), FOUND)
        new = new if found is None else new.unionByName(found.drop("rank"))
        found = scratch(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best")
        first, size = end, size * GROWTH
    return asked.sparkSession.createDataFrame([], FOUND + ", rank int") if found is None else found


def share_of(score: Column, per_cent: int) -> Column:
    """The largest whole number that is at most this share of the score."""
    part = score * per_cent
    return F.call_function("div", part - F.pmod(part, F.lit(100)), F.lit(100)).cast("long")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    ``positives`` rows of the same label the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent
    of the positive's."""
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(vector_col, scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    )
    rows = scratch(rows.groupBy("id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("r")).select("id", "r.*"), "rows")
    same, k = Window.partitionBy("label", "v"), max(positives + 1, negatives)
    few = rows.select("id", "label", "v").withColumn("n", F.row_number().over(same.orderBy("id"))).where(F.col("n") <= k)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    few = scratch(few.select("id", "label", "v", norm.alias("norm"), F.col("n") == 1), "vectors").toDF("id", "label", "v", "norm", "is_first")
    candidates, bounds = in_buckets(few.select("id", "label", "v", "norm"))

    # a: the smallest id of an anchor's vector and label, which stands for the search
    firsts = few.where("is_first").select(F.col("id").alias("a"), "label", "v", "norm")
    anchors = scratch(rows.where("is_anchor").select("id", "label", "v").join(firsts, ["label", "v"]).select(F.col("id").alias("anchor_id"), "a", "label", "v", "norm"), "anchors")
    asked = scratch(anchors.select("a", "label", "v", "norm").dropDuplicates(["a"]), "searches")
    everything = asked.select("a", F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = search(asked, everything, candidates, bounds, positives + 1, True).select("a", "id", "score")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    paired = anchors.select("anchor_id", "a").join(near, "a").where(F.col("anchor_id") != F.col("id")).withColumn("n", place).where(F.col("n") <= positives)
    limits = (-share_of(-F.col("score"), low)).alias("lo"), share_of(F.col("score"), high).alias("hi")
    paired = scratch(paired.select("anchor_id", "a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *limits), "positives").where("lo <= hi")

    windows = scratch(paired.select("a", "lo", "hi").distinct(), "windows")
    hard = search(asked, windows, candidates, bounds, negatives, False)
    found = paired.join(hard, ["a", "lo", "hi"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as anchor_id, q.label as anchor_label, x.vec_id, x.label, list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 50 = 0
),
positives as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where label = anchor_label),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank, s.vec_id as negative_id,
    p.score as positive_score, s.score as negative_score
  from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
  where p.n <= 5
)
select * from ranked where rank <= 3
"""
