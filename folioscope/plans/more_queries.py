"""Directories, catalogues, audits, merged rankings, surveys, citations, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import corpus as C
from folioscope.operators import govern as G
from folioscope.operators import retrieval as R
from folioscope.operators import tables as T
from folioscope.plans.ingest_queries import values
from folioscope.plans.kernel_queries import grid
from folioscope.plans.registry import query, read
from folioscope.plans.retrieval_queries import COS, SCORED, nearest
from folioscope.plans.table_queries import cells


@query("""select * from (values ('amzn-20231231.pdf', 'AWS', 'Operating income', ['2021', '2022', '2023']), ('amzn-20231231.pdf', 'International', 'Operating income', ['2021', '2022', '2023']),
('amzn-20231231.pdf', '', 'Net income (loss)', ['2021', '2022', '2023'])) as t(doc, section, label, periods)""")
def line_item_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.line_items(grid(spark), "income", "2023")


@query("""select * from (values ('goog-20221231.pdf', 't1', 'Total revenues: 2021' || chr(10) || 'Google advertising: 2021', false), ('msft-10k_20220630.htm.pdf', 't1', 'Revenue / Total: 2021, 2022', false), ('msft-10k_20220630.htm.pdf', 't2', 'Percent of revenue / Total revenue: 2022', false)) as t(doc, table_id, text, percent)""")
def grid_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.catalog_text(grid(spark).where("doc not like 'amzn%'"))


@query("""select 'income' as table_id, '[income] caption' as text, '[{"section":"","label":"Net sales","values":["469,822","513,983"]},{"section":"Operating income","label":"AWS","values":["18,532","22,841"]},{"section":"Operating income","label":"Change","values":["7%","(1)%"]}]' as table_json""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = cells(spark).where("table_id = 'income'")
    rows = T.built_rows(tidy, T.value_widths(tidy.withColumn("text", T.clean(F.col("text")))))
    return T.table_chunks(rows, values(spark, "table_id string, caption string", [("income", "caption")]))


@query("select * from (values ('d', 1, 'covered'), ('d', 2, 'missed'), ('d', 3, 'junk'), ('d', 4, 'empty')) as t(doc, page, state)")
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = values(spark, "doc string, page int, data_lines int", [("d", 1, 4), ("d", 2, 2), ("d", 3, 0), ("d", 4, 0)])
    return T.page_audit(pages, values(spark, "doc string, page int", [("d", 1), ("d", 1), ("d", 3)])).select("doc", "page", "state")


@query(f"""with p as (select vec_id // 60 as query_id, vec_id // 20 % 3 as sub_ix, embedding from embeddings where vec_id % 20 = 0), s as (select query_id, sub_ix, vec_id, {COS} as score from embeddings e, p),
r as (select *, row_number() over (partition by query_id, sub_ix order by score desc, vec_id) as rank from s), f as (select query_id, vec_id, min(sub_ix * 100 + rank) as first_place from r where rank <= 6 group by all)
select query_id, vec_id, row_number() over (partition by query_id order by first_place, vec_id)::int as rank from f""")
def subquery_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a sub-query; three make a question."""
    place = F.floor(F.col("query_id") / 20)
    top = nearest(spark, sf_dir, 6).select(F.floor(place / 3).alias("query_id"), (place % 3).alias("sub_ix"), "rank", "vec_id")
    return R.merged(top, ["vec_id"])


SURVEY = f"""with {SCORED}, b as (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as n from s), sv as (select query_id, label, count(*) as evidence, max(score) as score from b where n <= 8 group by all)
select query_id, label, evidence, round(score, 6) as score, row_number() over (partition by query_id order by evidence desc, sv.score desc, label)::int as rank from sv"""


@query(SURVEY)
def collection_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is surveyed by its own best chunks, without a cut over the whole collection."""
    best = nearest(spark, sf_dir, 8, "label").select("query_id", F.col("label").alias("doc"), F.col("vec_id").alias("chunk"), "score")
    return R.survey(best).select("query_id", F.col("doc").alias("label"), "evidence", F.round("score", 6).alias("score"), "rank")


@query(SURVEY)
def collection_survey_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that ``collection_survey`` had while it was cut to 60 vectors."""
    return collection_survey(spark, sf_dir)


@query("select doc_id from documents where doc_id % 50 = 1")
def collection_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return R.resolved_scope(docs, docs.where("doc_id % 50 = 1"))


@query("select * from (values (0, true), (1, false), (2, null)) as t(id, cited)")
def cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, text string, section string", [(0, "under section 16A, no suit", "16A"), (1, "under section 16, no suit", "16A"), (2, "x", None)])
    return rows.select("id", C.cites(F.col("text"), F.col("section")).alias("cited"))


@query("select p_partkey, coalesce(case when p_partkey % 2 = 0 then p_type end, 'of ' || p_brand) as kind from part")
def inherited_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    own = part.select("p_partkey", F.col("p_brand").alias("source_key"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("kind"))
    given = part.select(F.col("p_brand").alias("source_key")).distinct().withColumn("kind", F.concat(F.lit("of "), "source_key"))
    return C.inherited(own, given, ["kind"]).select("p_partkey", "kind")


@query("select c_nationkey as firm_id, count(*) filter (c_mktsegment = 'BUILDING') as n from customer group by 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.role_counts(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("firm_id"), F.col("c_mktsegment").alias("role")), "BUILDING")


@query("select o_orderkey, case when o_custkey = 5 then 6 else o_custkey end as owner_id from orders")
def reassigned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id"))
    handed, _ = G.member_removed(items, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), 5, 6)
    return handed


@query("select event_id, case when event_type in ('click', 'view') then user_id + 1 else user_id end as recipient from events")
def notification_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_type") == "click", "review.approved").when(F.col("event_type") == "view", "review.released").otherwise("review.awaiting")
    return read(spark, sf_dir, "events").select("event_id", G.recipient(event, F.col("user_id"), F.col("user_id") + 1).alias("recipient"))
