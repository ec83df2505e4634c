"""Spans, claims, ledgers, comparisons, budgets, scores and the rest of the review desk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import review as V
from folioscope.operators import scope
from folioscope.plans.ingest_queries import LINES, sql_values, values
from folioscope.plans.registry import query, read

NAMES = [("legal_contract", "Share Purchase Agreement.pdf"), ("financial_filing", "loan.pdf"), ("generic", "loan-facility_v2.docx"), (None, "Smith vs Jones.pdf"), ("mixed", "vsomething.pdf"), ("other", "loan.pdf"), ("generic", None)]


@query("select * from (values (0, 'm&a'), (1, null), (2, 'lending'), (3, 'litigation'), (4, null), (5, null), (6, null)) as t(id, kind)")
def matter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, doc_type string, name string", [(i, *r) for i, r in enumerate(NAMES)])
    return rows.select("id", V.matter_kind(F.col("doc_type"), F.col("name")).alias("kind"))


@query("select doc_id from documents left join labels using (doc_id) where not coalesce(toxic = 1, false)")
def privileged_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("privileged")), "doc_id", "left")
    return V.without_privileged(docs).select("doc_id")


@query("select doc_id, coalesce(quality = 0, false) as fidelity_warning from documents left join labels using (doc_id)")
def fidelity_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "partial").otherwise("good").alias("grade"))
    return V.warned(read(spark, sf_dir, "documents").select("doc_id"), grades)


@query("select ['compute', 'search'] as tools")
def allowed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda *x: F.array(*map(F.lit, x))
    return spark.range(1).select(V.known_tools(names("compute", "hack", "search"), names("search", "read", "compute")).alias("tools"))


@query("select event_id from events where event_type = 'click' and user_id is not null and user_id % 3 <> 1")
def foreign_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "span").otherwise("cell").alias("kind"), (F.col("user_id") % 3).alias("collection_id"))
    return ledger.where(scope.foreign_spans(ledger, 1)).select("event_id")


@query(f"""with {LINES}, f as (select *, row_number() over (partition by doc_id order by elem_ix) as n from lines) select doc_id, md5(left(string_agg(text, chr(10) || chr(10) order by elem_ix), 3000)) as text_md5 from f where n <= 8 group by doc_id""")
def comparison_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return V.comparison_input(chunks).select("doc_id", F.md5("text").alias("text_md5"))


COMPARED = [(1, "## Similarities\n- both pay\n* both renew\n\nDifferences:\n- rent\nnot a bullet")]


@query("select * from (values (1, 'Similarities', 1, 'both pay'), (1, 'Similarities', 2, 'both renew'), (1, 'Differences', 5, 'rent')) as t(id, section, ix, point)")
def comparison_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.comparison_points(values(spark, "id int, text string", COMPARED), "id")


@query(f"""with {LINES}, s as (select doc_id as span_id, doc_id, lower(left(trim(substr(text, 1, 200)), 60)) as b from documents),
h as (select span_id, s.doc_id, coalesce(min(elem_ix) filter (b <> '' and contains(lower(text), b)), min(elem_ix)) as chunk_index from s join lines using (doc_id) group by all) select * from h""")
def spans_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return V.spans_to_chunks(docs.select(F.col("doc_id").alias("span_id"), "doc_id", F.substring("text", 1, 200).alias("span")), chunks)


@query("with x as (select distinct turn as claim_ix, conv_id as doc_id, md5(text) as claim from conversations) select doc_id, md5(string_agg(claim, ',' order by claim_ix, claim)) as claims_md5, count(*) as n from x group by doc_id")
def claims_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select(F.col("turn").alias("claim_ix"), F.md5("text").alias("claim"), F.array("conv_id", "conv_id").alias("doc_ids")).distinct()
    per = V.claims_by_document(said)
    return per.select("doc_id", F.md5(F.array_join("claims", ",")).alias("claims_md5"), F.size("claims").cast("long").alias("n"))


@query("with x as (select distinct turn as claim_ix, conv_id as doc_id, md5(text) as claim from conversations) select doc_id, row_number() over (partition by doc_id order by claim_ix, claim)::int as position, claim from x")
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims under their real conversation, as ordered rows."""
    said = read(spark, sf_dir, "conversations").select(F.col("turn").alias("claim_ix"), F.md5("text").alias("claim"), F.array("conv_id").alias("doc_ids")).distinct()
    return V.claim_rows(said)


PROVENANCE = [
    (1, 0, [("cell", "d", 1, "Net sales", "2022", None), None]), (1, 1, [(None, "d", 2, None, None, "c1"), ("param", None, None, "threshold", None, None), ("cell", "d", 1, "Net sales", "2022", None)]),
    (2, 0, [("span", "e", None, None, None, "c9")]),
]


@query("select * from (values (1, 'd', 1, 'Net sales', '2022', null, 1), (1, 'd', 2, null, null, 'c1', 2), (2, 'e', null, null, null, 'c9', 1)) as t(run_id, doc, page, label, period, chunk_id, source_id)")
def ledger_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "run_id int, step int, provenance array<struct<kind:string,doc:string,page:int,label:string,period:string,chunk_id:string>>", PROVENANCE)
    return V.ledger_sources(V.ledger_rows(rows))


MODES = [("fast", 0, 1000, 10.0), ("deep", 6, 4000, 300.0)]


@query(f"""with s as (select user_id as run_id, case when user_id % 2 = 0 then 'fast' else 'deep' end as mode, row_number() over (partition by user_id order by event_id)::int as step, (event_id % 900)::bigint as tokens, value as seconds from events),
u as (select *, sum(tokens) over w as ut, sum(seconds) over w as us from s window w as (partition by run_id order by step))
select run_id, u.step, u.step >= most_steps or ut >= most_tokens or us >= most_seconds as exhausted from u join {sql_values(MODES, 'mode, most_steps, most_tokens, most_seconds')} using (mode)""")
def budget_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    steps = e.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 2 == 0, "fast").otherwise("deep").alias("mode"), "step", (F.col("event_id") % 900).alias("tokens"), F.col("value").alias("seconds"))
    return V.exhausted(steps, values(spark, "mode string, most_steps int, most_tokens int, most_seconds double", MODES)).select("run_id", "step", "exhausted")


JOURNAL = [(1, 0, "empty_search"), (1, 1, "gate_fail"), (1, 2, "abstain"), (2, 0, "gate_fail"), (2, 1, "answer"), (3, 0, "abstain"), (4, 3, "budget"), (4, 4, "abstain")]


@query("select * from (values (1, 'no_evidence'), (3, 'unknown'), (4, 'budget')) as t(run_id, cause)")
def abstain_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.abstain_causes(values(spark, "run_id int, step int, kind string", JOURNAL))


@query("""with t as (select n_name as doc, s_name as label, s_acctbal as v, s_suppkey as k from supplier join nation on s_nationkey = n_nationkey)
select doc, round(avg(case when k % 4 <> 0 then 1 else 0 end), 6) as coverage, round(avg(case when k % 4 <> 0 and k % 3 <> 0 then 1 else 0 end), 6) as accuracy from t group by doc""")
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cells = t.select(F.col("n_name").alias("doc"), F.lit("s").alias("section"), F.col("s_name").alias("label"), F.lit("2023").alias("period"), F.col("s_acctbal").alias("value"), "s_suppkey")
    found = cells.where("s_suppkey % 4 <> 0").withColumn("value", F.when(F.col("s_suppkey") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return V.extraction_scores(cells.drop("s_suppkey"), found.drop("s_suppkey"))


@query("with l as (select event_type, list(value order by value) as s from events group by 1) select event_type, s[least(len(s), floor(len(s) * 0.5)::int + 1)] as p50, s[least(len(s), floor(len(s) * 0.95)::int + 1)] as p95 from l")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latency_percentiles(read(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds")), "event_type")


RESULTS = [(1, "d", "90,757"), (2, "d", "1,111"), (3, "e", "5"), (4, "d", "n/a")]


@query("select * from (values (1, 'd', '90,757', true), (2, 'd', '1,111', false), (3, 'e', '5', false), (4, 'd', 'n/a', false)) as t(result_id, doc, raw, corroborated)")
def prose_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.corroborated(values(spark, "result_id int, doc string, raw string", RESULTS), values(spark, "doc string, text string", [("d", "sales were 90,757 in 2023"), ("d", "other")]))


@query("select s_suppkey as result_id, '| ' || s_name || ' | ' || replace(s_suppkey::varchar || '|x', '|', '\\|') || ' |' as line from supplier")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("result_id"), "s_name", F.concat(F.col("s_suppkey").cast("string"), F.lit("|x")).alias("raw"))
    return V.result_table(rows)


@query("select event_id from events where event_type in ('click', 'view') and user_id = 7")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "awaiting").when(F.col("event_type") == "view", "changes_requested").otherwise("approved")
    items = read(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), status.alias("status"), F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at"))
    return V.review_queue(items, 7).select(F.col("item_id").alias("event_id"))


@query("select * from (values ('term', 'five years', true), ('law', 'Delaware', false)) as t(topic, position, overridden)")
def playbook_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "doc_type string, topic string, standard string", [("nda", "term", "two years"), ("nda", "law", "Delaware"), ("lease", "rent", "monthly")])
    return V.playbook(rows, values(spark, "topic string, position string", [("term", "five years")]), "nda")


@query("select * from (values (1, 'NDA', 'nda template'), (2, 'unknown', 'plain'), (3, null, 'plain')) as t(id, kind, template)")
def template_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = values(spark, "id int, kind string", [(1, "NDA"), (2, "unknown"), (3, None)])
    return V.with_default(asked, values(spark, "kind string, template string", [("nda", "nda template"), ("Generic", "plain")]), "kind", "generic")


@query('select \'events\' as "table", count(*) as rows from events where user_id = 5 union all select \'orders\', count(*) from orders where o_custkey = 5')
def personal_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.export_manifest({"events": read(spark, sf_dir, "events"), "orders": read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")}, 5)


@query("select o_orderkey, (o_orderdate::date + 90) as due, o_orderdate::date <= date '1997-01-01' - 365 as deletable from orders")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("requested_at"), F.col("o_orderdate").alias("created_at"))
    return V.deletable(rows, F.lit("1997-01-01").cast("date")).select("o_orderkey", "due", "deletable")
