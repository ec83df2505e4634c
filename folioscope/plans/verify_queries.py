"""Verification and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import verify as V
from folioscope.plans.ingest_queries import q, sql_values, values
from folioscope.plans.registry import query, read

SENTENCES = "sents as (select doc_id, u[1]::int - 1 as sent_ix, trim(u[2]) as sentence from (select doc_id, unnest(list_zip(range(1, len(p) + 1), p)) as u from (select doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)) as p from documents)) where trim(u[2]) <> '')"


@query(f"with {SENTENCES} select doc_id, sent_ix, md5(sentence) as sentence_md5 from sents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentences(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "sent_ix", F.md5("sentence").alias("sentence_md5"))


@query(f"""with t as (select distinct doc_id, trim(unnest(list_distinct(regexp_extract_all(text, {q(P.FIGURE)})))) as token from documents),
f as (select *, try_cast(regexp_replace(token, '[$,\\s]', '', 'g') as double) as x from t),
g as (select * from f where x is not null and (regexp_matches(token, '[,.$]') or x >= 10000)),
v as (select distinct abs(p_retailprice) * s as v from part, (values (1.0::double), (0.001), (1000.0), (0.000001), (1000000.0)) as k(s))
select doc_id, token, bool_or(coalesce(abs(x - v) <= 0.01 * greatest(v, 1.0), false)) as traces from g left join v on v > 0 group by doc_id, token""")
def figure_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.figures(read(spark, sf_dir, "documents"), "doc_id")
    return V.traced(found, read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("value")), "doc_id").select("doc_id", "token", "traces")


_S, _REST = "trim(sentence)", f"trim(regexp_replace(trim(sentence), {q(P.INPUT_NEEDED)}, '', 'g'))"
FACTUAL = f"(length({_S}) >= 25 and not regexp_matches({_S}, {q(P.SCAFFOLD)}) and not (contains(upper({_S}), '[INPUT NEEDED') and not regexp_matches({_REST}, '\\d')) and length({_REST}) >= 25 and (regexp_matches({_REST}, '\\d') or regexp_matches({_REST}, {q(P.CONTENT_WORD)})))"


@query(f"with {SENTENCES} select doc_id, count(*) as sentences, count(*) filter ({FACTUAL}) as factual, count(*) filter ({FACTUAL} and not regexp_matches(sentence, {q(P.CITATION)})) as uncited from sents group by doc_id")
def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    sents = V.sentences(read(spark, sf_dir, "documents"), "doc_id")
    return sents.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(V.is_factual(s)).alias("factual"), F.count_if(V.is_factual(s) & ~V.is_cited(s)).alias("uncited"))


DRAFT = [
    (1, "# Agreement"), (2, "Revenue grew to 80,096 in fiscal 2022 [amzn p.41]."), (3, "The party shall pay all costs under the agreement."),
    (4, "The Disclosing Party is [INPUT NEEDED: name]."), (5, "Insufficient evidence in the vault to draft this section."), (6, "Short one."),
]


@query("select * from (values (1, false, false, false), (2, true, true, true), (3, true, false, false), (4, false, true, false), (5, false, false, false), (6, false, false, false)) as t(id, factual, cited, figure)")
def draft_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    return values(spark, "id int, sentence string", DRAFT).select("id", V.is_factual(s).alias("factual"), V.is_cited(s).alias("cited"), V.has_substantive_figure(V.without_citations(s)).alias("figure"))


CLAIMS = [
    (1, "The lease between Acme and Delaware Holdings covers the warehouse premises", "lease of warehouse premises signed by acme for delaware holdings"),
    (2, "The lease between Initech and Umbrella covers the warehouse premises", "lease of warehouse premises signed by acme for delaware holdings"),
    (3, "Yes it is", "yes it is"), (4, "Parties agreed on payment schedule", None),
]


@query("select * from (values (1, true), (2, false), (3, false), (4, false)) as t(id, grounded)")
def claim_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "id int, sentence string, evidence string", CLAIMS).select("id", V.grounded(F.col("sentence"), F.col("evidence")).alias("grounded"))


STOP = "[" + ", ".join(map(q, P.STOPWORDS)) + "]"
_TOKS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, {1}), lambda t: regexp_replace(lower(t), '^[.''/&-]+|[.''/&-]+$', '', 'g')), lambda t: length(t) >= 3 and not list_contains({2}, t)))"
_CONTENT = _TOKS.format("text", q(P.TOKEN), STOP)


@query(f"""with b as (select item_id, {_CONTENT} as toks from benchmark), d as (select doc_id, lower(text) as corpus from documents)
select item_id, doc_id, round(len(list_filter(toks, lambda t: contains(corpus, t)))::double / len(toks), 6) as share from b, d where len(toks) >= 3 and len(list_filter(toks, lambda t: contains(corpus, t)))::double / len(toks) >= 0.6""")
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as claims against all documents as evidence."""
    return claim_grounding_all(spark, sf_dir)


@query()
def claim_grounding_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as claims against all documents as evidence."""
    return V.grounded_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumn("share", F.round("share", 6))


@query(f"""with {SENTENCES} select doc_id, md5(trim(coalesce(string_agg(sentence, ' ' order by sent_ix) filter (not regexp_matches(sentence, '\\d')), '') || case when count(*) filter (regexp_matches(sentence, '\\d')) > 0 then ' (withheld)' else '' end)) as text_md5,
 count(*) filter (regexp_matches(sentence, '\\d')) as dropped from sents group by doc_id""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = V.sentences(read(spark, sf_dir, "documents"), "doc_id")
    kept = V.redacted(sents, "doc_id", ~F.col("sentence").rlike(r"\d"), "(withheld)")
    return kept.select("doc_id", F.md5(F.trim("text")).alias("text_md5"), "dropped")


SECTIONS = [(1, "intro\n## A\nbody one\nmore\n## B\n")]


@query("select * from (values (1, 0::bigint, null, 'intro'), (1, 1, '## A', 'body one' || chr(10) || 'more'), (1, 2, '## B', '')) as t(id, section_ix, header, body)")
def sectioned_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sections(values(spark, "id int, text string", SECTIONS), "id")


ASKED = [(1, "Compare Acme, Globex and Initech in 2022", "Acme reported 5 and Globex is flat."), (2, "What is revenue?", "It rose.")]


@query("select * from (values (1, 'Acme', true), (1, 'Globex', true), (1, 'Initech', false)) as t(id, entity, addressed)")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, question string, answer string", ASKED).select("id", "answer", F.explode(V.entities_asked(F.col("question"))).alias("entity"))
    return rows.select("id", "entity", V.addressed(F.col("answer"), F.col("entity")).alias("addressed"))


@query("""select count(*) as routed, count(*) filter (quality is not null) as read, count(*) filter (quality = 1) as relevant, count(*) filter (toxic = 1) as failed, count(*) filter (quality is not null)::double / count(*) >= 0.9 as quorum_met from documents left join labels using (doc_id)""")
def coverage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return V.coverage(d.select(F.col("quality").isNotNull().alias("read"), (F.coalesce("quality", F.lit(0)) == 1).alias("relevant"), (F.coalesce("toxic", F.lit(0)) == 1).alias("failed")))


CALLS = "c as (select user_id as run_id, event_type as tool, event_type || coalesce(json_extract_string(props, '$.k'), '') as signature, value > 10 as ok, event_id from events)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls of one run per user."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("tool"), F.concat("event_type", F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("signature"), (F.col("value") > 10).alias("ok"), "event_id")


@query(f"""with {CALLS}, t as (select run_id, count(*) filter (n >= 2 and good = 0) as dead_tools from (select run_id, tool, count(*) as n, count(*) filter (ok) as good from c group by all) group by run_id),
a as (select run_id, count(*) filter (n >= 3) as repeated_calls from (select run_id, signature, count(*) as n from c group by all) group by run_id)
select run_id, dead_tools, repeated_calls, dead_tools = 0 and repeated_calls = 0 as healthy from t join a using (run_id)""")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_health(calls(spark, sf_dir))


@query(f"""with {CALLS} select event_id, coalesce(sum(case when ok then 0 else 1 end) over (partition by run_id, signature order by event_id rows between unbounded preceding and 1 preceding), 0) >= 2 as blocked from c""")
def blocked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocked_calls(calls(spark, sf_dir), "event_id").select("event_id", "blocked")


@query("""with d as (select source as query_id, list(doc_id) as ids from documents where doc_id % 2 = 0 group by source), g as (select source as query_id, list(doc_id) as gold from documents join labels using (doc_id) where quality = 1 group by source)
select query_id, round(case when coalesce(len(gold), 0) = 0 then 1.0 else len(list_intersect(ids, gold))::double / len(gold) end, 6) as recall from d left join g using (query_id)""")
def routing_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.where("doc_id % 2 = 0").select(F.col("source").alias("query_id"), "doc_id")
    gold = docs.join(read(spark, sf_dir, "labels"), "doc_id").where("quality = 1").select(F.col("source").alias("query_id"), "doc_id")
    return V.routing_recall(found, gold).withColumn("recall", F.round("recall", 6))


BASE = [("faithfulness", 0.9), ("recall", 0.85), ("gone", 0.7)]
NOW = [("faithfulness", 0.86), ("recall", 0.79), ("new", 0.5)]


@query(f"""select coalesce(b.metric, n.metric) as metric, b.value as was, n.value as now, n.value is null or coalesce(b.value - n.value > 0.05, false) or coalesce(contains(coalesce(b.metric, n.metric), 'recall') and n.value < 0.8, false) as failed
from {sql_values(BASE, 'metric, value').replace('as t(', 'as b(')} full outer join {sql_values(NOW, 'metric, value').replace('as t(', 'as n(')} on b.metric = n.metric""")
def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.regressions(values(spark, "metric string, value double", BASE), values(spark, "metric string, value double", NOW))


SCORES = [("faithfulness", 0.9), ("faithfulness", None), ("faithfulness", float("nan")), ("precision", 1.0), ("precision", 0.5), ("empty", None)]


@query("select * from (values ('faithfulness', 0.9::double, 1::bigint, 2::bigint), ('precision', 0.75, 2, 0), ('empty', null, 0, 1)) as t(metric, mean, valid, missing)")
def metric_null_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.metric_means(values(spark, "metric string, score double", SCORES))


ANSWERS = [("lookup", 13.3, 13.31), ("lookup", 5.0, 9.0), ("extremum", None, 2.0), ("extremum", 2.0, 2.0)]


@query(f"""select kind, count(*) filter (a is not null and abs(a - t) <= 0.005 * abs(t)) as correct, count(*) filter (a is null) as abstained, count(*) filter (a is not null and abs(a - t) > 0.005 * abs(t)) as wrong from {sql_values(ANSWERS, 'kind, a, t').replace('as t(', 'as v(')} group by kind""")
def evaluation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.outcome(F.col("a"), F.col("t"))
    rows = values(spark, "kind string, a double, t double", ANSWERS)
    return rows.groupBy("kind").agg(F.count_if(o == "CORRECT").alias("correct"), F.count_if(o == "ABSTAINED").alias("abstained"), F.count_if(o == "WRONG").alias("wrong"))


STATES = [(1, "Found", "x", 2), (2, "found", "x", 0), (3, "missing", None, None), (4, "maybe", "y", 1), (5, None, None, None)]


@query("select * from (values (1, 'found'), (2, 'abstain'), (3, 'missing'), (4, 'error'), (5, 'error')) as t(id, status)")
def grid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, status string, value string, n_sources int", STATES)
    return rows.select("id", V.grid_status(F.struct("status", "value", "n_sources")).alias("status"))


FINDINGS = [
    ("term", "two years", '{"deviation": true, "quote": "five years", "rationale": "longer"}'), ("law", "Delaware", '{"deviation": true, "quote": ""}'),
    ("fees", "none", "not json"), ("notice", "30 days", '{"deviation": false, "quote": "30 days"}'), ("seat", "Paris", "{}"),
]


@query("""select * from (values ('term', 'deviation', true, 'term → two years'), ('law', 'abstain', false, 'law → Delaware'), ('fees', 'abstain', false, 'fees → none'), ('notice', 'standard', true, 'notice → 30 days'), ('seat', 'abstain', false, 'seat → Paris')) as t(topic, status, grounded, source_ref)""")
def redline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.redline(values(spark, "topic string, standard string, raw string", FINDINGS))


@query("""with s as (select conv_id, role as doc, turn % 3 as chunk, min(turn) as first_turn from conversations group by all) select conv_id, doc, chunk, row_number() over (partition by conv_id order by first_turn, doc, chunk)::int as source_id from s""")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("doc"), (F.col("turn") % 3).alias("chunk"), "turn")
    return V.sources(spans, "conv_id", "turn")


CONF = [(1, "text\n## Confidence: 80", 0.5), (2, "## Confidence 0.9", 1.0), (3, "none", 0.8)]


@query("select * from (values (1, 0.4::double, true), (2, 0.9, false), (3, 0.4, true)) as t(id, confidence, abstain)")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, abstain = V.stated_confidence(F.col("answer"), F.col("g"))
    return values(spark, "id int, answer string, g double", CONF).select("id", value.alias("confidence"), abstain.alias("abstain"))


@query("""select doc_id, case when length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 300 then trim(regexp_replace(text, '\\s+', ' ', 'g')) else regexp_replace(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 300), '\\s+\\S*$', '') || '…' end as snippet from documents""")
def clean_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", V.clean_snippet(F.col("text")).alias("snippet"))


NAMES = ["the", "license", "idiot", "zzz", ""]
_PARTS = "string_split(lower(text), entity)"
_AT = f"length(array_to_string({_PARTS}[1:i], '')) + (i - 1) * length(entity) + 1"


@query(f"""with e as (select unnest({[n for n in NAMES]}) as entity),
a as (select doc_id, entity, case when entity = '' then true else coalesce(list_bool_or(list_transform(range(1, len({_PARTS})), lambda i: regexp_matches(substr(lower(text), greatest({_AT} - 200, 1), {_AT} + length(entity) + 200 - greatest({_AT} - 200, 1)), {q(V.STATED)}))), false) end as addressed from documents, e)
select * from a""")
def entity_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer, and whether it addresses each of a few names at any of its mentions."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, NAMES))).alias("entity"))
    return docs.select("doc_id", "entity", V.addressed(F.col("text"), F.col("entity")).alias("addressed"))


FIGURES = f"""t as (select distinct doc_id, trim(unnest(list_distinct(regexp_extract_all(text, {q(P.FIGURE)})))) as token from documents),
f as (select *, try_cast(regexp_replace(token, '[$,\\s]', '', 'g') as double) as x from t),
g as (select * from f where x is not null and (regexp_matches(token, '[,.$]') or x >= 10000)),
v as (select distinct abs(p_retailprice) * s as v from part, (values (1.0::double), (0.001), (1000.0), (0.000001), (1000000.0)) as k(s)),
tr as (select doc_id, token, bool_or(coalesce(abs(x - v) <= 0.01 * greatest(v, 1.0), false)) as traces from g left join v on v > 0 group by doc_id, token),
pf as (select doc_id, count(*) as checked, count(*) filter (not traces) as untraced from tr group by doc_id),
fc as (select doc_id, coalesce(checked, 0) as checked, coalesce(untraced, 0) as untraced from documents left join pf using (doc_id))"""


@query(f"""with {FIGURES} select doc_id, checked, untraced, true as decided, round(1 - case when checked > 0 then untraced::double / checked else 0 end, 6) as groundedness, untraced = 0 as ok from fc""")
def figure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those without figures too, against the prices of parts."""
    cells = read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("value"))
    return V.figure_check(read(spark, sf_dir, "documents").select("doc_id", "text"), cells, "doc_id")


@query(f"""with {FIGURES} select doc_id, checked, checked as untraced, false as decided, case when checked = 0 then 1.0 else 0.0 end::double as groundedness, checked = 0 as ok from fc""")
def figure_gate_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any cell, stated figures fail and texts without figures pass."""
    none = read(spark, sf_dir, "part").where(F.lit(False)).select(F.col("p_retailprice").alias("value"))
    return V.figure_check(read(spark, sf_dir, "documents").select("doc_id", "text"), none, "doc_id")


@query(f"""with {SENTENCES} select doc_id, count(*) filter (length(sentence) >= 25) as long, count(*) filter (length(sentence) >= 25 and regexp_matches(sentence, '[0-9]')) as supported,
 round(case when count(*) filter (length(sentence) >= 25) = 0 then 1.0 else count(*) filter (length(sentence) >= 25 and regexp_matches(sentence, '[0-9]'))::double / count(*) filter (length(sentence) >= 25) end, 6) as groundedness from sents group by doc_id""")
def supported_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a digit stand for those that a verifier supports."""
    return V.supported_share(V.sentences(read(spark, sf_dir, "documents"), "doc_id"), "doc_id", F.col("sentence").rlike("[0-9]"))


@query("""with e as (select o_custkey as run_id, o_orderpriority as label, year(o_orderdate)::varchar as period, o_orderstatus as doc, round(o_totalprice)::bigint::varchar as shown, min(o_orderkey) as ix from orders group by all),
p as (select *, row_number() over (partition by run_id order by ix) as place from e)
select run_id, string_agg('- **' || label || '** (' || period || '): ' || shown || ' [' || doc || ' p.' || (ix % 90) || ']', chr(10) order by place) as lines, count(*) as n_lines from p where place <= 20 group by run_id""")
def partial_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the verified cells of a run per customer."""
    o = read(spark, sf_dir, "orders")
    entries = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ix"), F.lit("cell").alias("kind"), F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("doc"), (F.col("o_orderkey") % 90).alias("page"), F.round("o_totalprice").cast("long").cast("string").alias("shown"))
    return V.partial_answer(entries, "run_id")


_NAMED = ["license", "password"]
_ADDR = "coalesce(list_bool_or(list_transform(range(1, len(string_split(low, '{0}'))), lambda i: regexp_matches(substr(low, greatest(length(array_to_string(string_split(low, '{0}')[1:i], '')) + (i - 1) * length('{0}') + 1 - 200, 1), length(array_to_string(string_split(low, '{0}')[1:i], '')) + (i - 1) * length('{0}') + 1 + length('{0}') + 200 - greatest(length(array_to_string(string_split(low, '{0}')[1:i], '')) + (i - 1) * length('{0}') + 1 - 200, 1)), {1}))), false)"
_BODY = "regexp_replace(text, '^\\s*#{1,6}[^\\n]*\\n', '')"


@query(f"""with bodies as (select doc_id, {_BODY} as text from documents), {SENTENCES.replace('from documents', 'from bodies')},
{FIGURES.replace('text, ', "regexp_replace(text, " + q(P.CITATION) + ", ' ', 'g'), ").replace('from documents)', 'from bodies)').replace('from documents left', 'from bodies left')},
su as (select doc_id, count(*) filter ({FACTUAL} and not regexp_matches(sentence, {q(P.CITATION)}) and len(list_filter(regexp_extract_all(regexp_replace(sentence, {q(P.CITATION)}, ' ', 'g'), {q(P.FIGURE)}), lambda t: regexp_matches(trim(t), '[,.$]') or coalesce(try_cast(regexp_replace(t, '\\s', '', 'g') as double), 0.0) >= 10000)) > 0) as uncited from sents group by doc_id),
b as (select doc_id, lower(text) as low from bodies),
cm as (select doc_id, list_filter(['License', 'password'], lambda e: not case when e = 'License' then {_ADDR.format('license', q(V.STATED))} else {_ADDR.format('password', q(V.STATED))} end) as dropped from b)
select doc_id, coalesce(uncited, 0) as uncited, dropped, list_filter([case when untraced > 0 then 'figures' end, case when uncited > 0 then 'citations' end, case when len(dropped) > 0 then 'completeness' end], lambda f: f is not null) as failures,
 untraced = 0 and coalesce(uncited, 0) = 0 and len(dropped) = 0 as passed from fc left join su using (doc_id) join cm using (doc_id)""")
def whole_answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the answer to a question about two things."""
    answers = read(spark, sf_dir, "documents").select("doc_id", F.lit("Compare License and password").alias("question"), F.col("text").alias("answer"))
    return V.answer_gates(answers, read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("value")), "doc_id")
