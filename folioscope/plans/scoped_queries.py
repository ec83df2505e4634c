"""Searches within a scope: versions in force on a question's date, several documents, several phrasings, sub-queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import corpus as C
from folioscope.operators import retrieval as R
from folioscope.operators.common import shared_dir
from folioscope.plans.ingest_queries import sql_values, values
from folioscope.plans.registry import query, read
from folioscope.plans.retrieval_queries import COS, COSINE, POOLED, QUESTIONS, probes, rounded, searched
from folioscope.sources import snapshots as N


@query(f"""with v as (select vec_id, embedding, case when vec_id % 13 <> 0 then o_orderdate::date end as enacted, case when vec_id % 11 <> 0 then o_orderdate::date + 400 end as horizon,
not (o_orderstatus = 'F' and vec_id % 4 = 0) and vec_id % 7 <> 0 as current, case when vec_id % 100 <> 0 then o_orderdate::date + 200 end as asked from embeddings join orders on o_orderkey = vec_id),
s as (select p.vec_id as query_id, e.vec_id, {COS} as score, e.current and (p.asked is null or coalesce(p.asked >= e.enacted, true) and coalesce(p.asked <= e.horizon, true)) as holds from v e, v p where p.vec_id % 20 = 0),
f as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s), w as (select query_id, count(*) filter (not holds) as withheld from f where n <= 10 group by query_id),
h as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s where holds) select query_id, vec_id, rank, round(score, 6) as score, withheld from h join w using (query_id) where rank <= 5""")
def asof_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are versions, enacted on the date of the order of their id; every twentieth asks for what was in force 200 days later,
    every hundredth for what is current."""
    key, day = F.col("vec_id"), F.to_date("o_orderdate")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_orderdate", "o_orderstatus")
    v = read(spark, sf_dir, "embeddings").join(orders, "vec_id")
    versions = v.select(
        "vec_id", "embedding", F.when(key % 13 != 0, day).alias("enacted_date"), F.when(key % 11 != 0, F.date_add(day, 400)).alias("as_of_date"),
        ((F.col("o_orderstatus") == "F") & (key % 4 == 0)).alias("repealed"), F.when(key % 7 == 0, "newer").alias("superseded_by"),
    )
    asked = v.where("vec_id % 20 = 0").select(key.alias("query_id"), F.col("embedding").alias("query_vector"), F.when(key % 100 != 0, F.date_add(day, 200)).alias("as_of"))
    return rounded(C.as_of_search(versions, asked, 5, "vec_id"), "score").select("query_id", "vec_id", "rank", "score", "withheld")


#: Labels in scope of question i: as many as i % 10 + 1, every third from i on.
LABELS = "sc as (select vec_id as query_id, i::int as place, ((vec_id // 20 + 3 * i) % 10)::int as label, least(vec_id // 20 % 10 + 1, 8) as n from embeddings, range(8) t(i) where vec_id % 20 = 0 and i <= vec_id // 20 % 10)"


def labels_in_scope(place):
    return F.transform(F.sequence(F.lit(0), (place % 10).cast("int")), lambda i: ((place + 3 * i) % 10).cast("int"))


@query(f"""with {LABELS}, s as (select query_id, place, sc.label, n, e.vec_id, {COS} as score from sc join embeddings p on p.vec_id = query_id join embeddings e on e.label = sc.label),
r as (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as own from s), c as (select * from r where own <= case when n <= 2 then 4 when n <= 4 then 3 else 2 end)
select query_id, label, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by place, own)::int as rank from c""")
def search_across_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for documents; questions name one to ten of them, of which eight are searched."""
    asked = probes(spark, sf_dir).withColumn("scope", labels_in_scope(F.floor(F.col("query_id") / 20)))
    return rounded(R.across_documents(read(spark, sf_dir, "embeddings"), asked, "vec_id", "label"), "score").select("query_id", "label", "vec_id", "score", "rank")


_PLACE = "p.vec_id // 20"
_ONE = POOLED.replace("embeddings p where p.vec_id % 20 = 0", f"embeddings p where p.vec_id % 20 = 0 and ({_PLACE} % 3 = 0 or {_PLACE} % 3 = 1 and e.label = {_PLACE} % 10)")


@query(f"""with {LABELS}, {_ONE}, s as (select query_id, place, sc.label, n, doc_id, {COS} as score from sc join embeddings p on p.vec_id = query_id join embeddings e on e.label = sc.label join documents on doc_id = e.vec_id where query_id // 20 % 3 = 2 and n > 1),
b as (select *, row_number() over (partition by query_id, label order by score desc, doc_id) as own from s), c as (select * from b where own <= case when n <= 2 then 4 when n <= 4 then 3 else 2 end)
select query_id, doc_id, round(score, 6) as score, rank from fused where rank <= 5 union all select query_id, doc_id, round(score, 6), row_number() over (partition by query_id order by place, own)::int from c""")
def retrieve_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the questions take all documents, a third one label, a third the labels that they name."""
    rows, asked = searched(spark, sf_dir)
    rows = rows.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    place = F.floor(F.col("query_id") / 20)
    several = F.when(place % 10 > 0, labels_in_scope(place)).otherwise(F.array().cast("array<int>"))
    asked = asked.withColumn("scope", F.when(place % 3 == 1, F.array((place % 10).cast("int"))).when(place % 3 == 2, several))
    return rounded(R.retrieve_scoped(rows, asked, 5, "doc_id", "label"), "score").select("query_id", "doc_id", "score", "rank")


_VARIANTS = f"""qs as (select distinct vec_id // 60 as query_id, query from embeddings join {sql_values(QUESTIONS, 'text_id, query')} on text_id = (vec_id // 60) % 4 + 1 where vec_id % 60 = 0),
d as (select p.vec_id // 60 as query_id, p.vec_id // 20 % 3 as sub_ix, e.vec_id as doc_id, {COS} as score from embeddings e join documents on doc_id = e.vec_id, embeddings p where p.vec_id % 20 = 0),
t as (select * from (select *, row_number() over (partition by query_id, sub_ix order by score desc, doc_id) as n from d) where n <= 10),
u as (select query_id, doc_id, sub_ix, n from t join documents using (doc_id) qualify row_number() over (partition by query_id, coalesce(text, '') order by sub_ix, n, doc_id) = 1),
dense as (select query_id, doc_id, row_number() over (partition by query_id order by sub_ix, n, doc_id) as rank from u)"""


@query(f"with {_VARIANTS}, {POOLED[POOLED.index('w as ('):].replace('where rank <= 20', '')} select query_id, doc_id, rank, round(score, 6) as score from fused where rank <= 5")
def multi_query_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a phrasing; three make a question, whose first one has the words."""
    rows, _ = searched(spark, sf_dir)
    place = F.floor(F.col("query_id") / 20)
    texts = values(spark, "text_id int, query string", QUESTIONS)
    given = probes(spark, sf_dir).withColumns({"text_id": F.floor(place / 3) % 4 + 1, "sub_ix": place % 3})
    variants = given.join(F.broadcast(texts), "text_id").select(F.floor(place / 3).alias("query_id"), "sub_ix", "query", "query_vector")  # four rows
    return rounded(R.multi_query(rows, variants, 5), "score").select("query_id", "doc_id", "rank", "score")


_BACK = COSINE.format(a="e.embedding", b="list_reverse(p.embedding)")


@query(f"""with s as (select p.vec_id // 60 as query_id, p.vec_id // 20 % 3 as sub_ix, e.vec_id, {_BACK} as score from embeddings e, embeddings p where p.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id, sub_ix order by score desc, vec_id) as n from s), f as (select query_id, vec_id, min(sub_ix * 100 + n) as seen from r where n <= 6 and score >= 0.4 group by all),
o as (select p.vec_id // 60 as query_id, e.vec_id, {COS} as score from embeddings e, embeddings p where p.vec_id % 60 = 0 and p.vec_id // 60 not in (select query_id from f)), q as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from o)
select query_id, vec_id, row_number() over (partition by query_id order by seen, vec_id)::int as rank, false as original from f union all select query_id, vec_id, rank, true from q where rank <= 6 and score >= 0.4""")
def subqueries_or_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries are every twentieth vector read backwards; where all three of a question find nothing, its first vector is asked."""
    place = F.floor(F.col("query_id") / 20)
    parts = probes(spark, sf_dir).select(F.floor(place / 3).alias("query_id"), (place % 3).alias("sub_ix"), F.reverse("query_vector").alias("query_vector"))
    whole = probes(spark, sf_dir).where(place % 3 == 0).select(F.floor(place / 3).alias("query_id"), "query_vector")
    return R.with_original(read(spark, sf_dir, "embeddings"), whole, parts, 6, "vec_id", 0.4).select("query_id", "vec_id", "rank", "original")


@query("""select case when vec_id % 2 = 0 then '00' || label else label::varchar end as namespace, vec_id as doc_id, vec_id % 4 as chunk_index, case when vec_id % 3 = 0 then 'second' else 'first' end as text,
embedding[1]::double * case when vec_id % 3 = 0 then 2 else 1 end as x from embeddings""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as a snapshot of tenants whose names differ by zeros only, and every third written again, doubled."""
    label = F.col("label").cast("string")
    rows = read(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("00"), label)).otherwise(label).alias("namespace"), F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 4).alias("chunk_index"),
        F.lit("first").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    N.save_snapshot(rows, path)
    N.save_snapshot(rows.where("doc_id % 3 = 0").withColumns({"text": F.lit("second"), "embedding": F.transform("embedding", lambda x: 2 * x)}), path)
    return N.read_snapshot(spark, path).select("namespace", "doc_id", "chunk_index", "text", F.col("embedding")[0].alias("x"))
