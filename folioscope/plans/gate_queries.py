"""Gates on questions and answers made of the documents, and lines that are padded and edged with digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import ingest, review
from folioscope.operators import verify as V
from folioscope.plans.ingest_queries import q
from folioscope.plans.registry import query, read

_QUESTIONS = """w as (select doc_id, regexp_extract_all(text, '[a-z]{4,}') as w from documents),
q as (select doc_id, case doc_id % 5 when 0 then 'Compare ' || w[1] || ', ' || w[2] || ', and ' || w[3] || ' revenue in FY2023' when 1 then 'For each of the following clauses: ' || w[1] || ', ' || w[2] || ' and ' || w[3] || '. Provide a table'
  when 2 then 'contrast ' || w[1] || ' and ' || w[2] when 3 then 'What changed between 2020 and 2022 for ' || w[1] || ' and ' || w[2] || '?' else w[1] || ' versus ' || w[2] || ', ' || w[3] end as question from w)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all(F.col("text"), F.lit("[a-z]{4,}"), F.lit(0))
    at = lambda i: F.try_element_at(w, F.lit(i))
    shape = F.col("doc_id") % 5
    said = (
        F.when(shape == 0, F.concat(F.lit("Compare "), at(1), F.lit(", "), at(2), F.lit(", and "), at(3), F.lit(" revenue in FY2023")))
        .when(shape == 1, F.concat(F.lit("For each of the following clauses: "), at(1), F.lit(", "), at(2), F.lit(" and "), at(3), F.lit(". Provide a table")))
        .when(shape == 2, F.concat(F.lit("contrast "), at(1), F.lit(" and "), at(2)))
        .when(shape == 3, F.concat(F.lit("What changed between 2020 and 2022 for "), at(1), F.lit(" and "), at(2), F.lit("?")))
        .otherwise(F.concat(at(1), F.lit(" versus "), at(2), F.lit(", "), at(3)))
    )
    return read(spark, sf_dir, "documents").select("doc_id", "text", said.alias("question"))


def _names(opening: str, closing: str, label: str = "") -> str:
    """SQL: the list of names between what opens and what ends it."""
    tail = f"trim(regexp_replace(trim(question), {q('(?s)^.*?' + opening)}, ''))"
    tail = f"regexp_replace({tail}, {q(label)}, '')" if label else tail
    return f"case when regexp_matches(question, {q(opening)}) then list_filter(list_transform(string_split_regex(string_split_regex({tail}, {q(closing)})[1], {q(P.LIST_SPLIT)}), lambda x: trim(x)), lambda x: x <> '') end"


@query(f"""with {_QUESTIONS}, n as (select doc_id, {_names(P.COMPARING, P.COMPARED_ENDS)} as a, {_names(P.FOR_EACH, P.EACH_ENDS, P.LIST_LABEL)} as b from q)
select doc_id, array_to_string(case when len(a) > 1 then a when len(b) > 1 then b else [] end, '|') as names, (case when len(a) > 1 then len(a) when len(b) > 1 then len(b) else 0 end)::int as n_names from n""")
def question_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions of five forms list; those without a known form list nothing."""
    return questions(spark, sf_dir).select("doc_id", V.entities_asked(F.col("question")).alias("e")).select("doc_id", F.array_join("e", "|").alias("names"), F.size("e").alias("n_names"))


@query()
def completeness_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the answer to a question about its own words."""
    return V.completeness(questions(spark, sf_dir).withColumnRenamed("text", "answer"), "doc_id").select("doc_id", F.array_join("dropped", "|").alias("dropped"), "complete")


@query(f"""with t as (select distinct doc_id, unnest(regexp_extract_all(text, {q(P.ANSWER_NUMBER)})) as token from documents),
k as (select *, regexp_replace(token, '%$', '') as u from t where not regexp_matches(regexp_replace(token, '^[()$%,]+|[()$%,]+$', '', 'g'), '^(19|20)\\d{{2}}$')),
d as (select *, regexp_replace(case when regexp_matches(u, '^\\(.*\\)$') then substr(u, 2, length(u) - 2) else u end, '[,$%\\s]', '', 'g') as digits from k),
n as (select doc_id, token, abs(try_cast(digits as double)) as x from d where regexp_matches(digits, '^-?\\d+(\\.\\d+)?$')),
g as (select * from n where x is not null and (regexp_matches(token, '[.,]') or x >= 100)),
v as (select p_retailprice::double as v from part union select avg(p_retailprice) from part),
tr as (select doc_id, token, bool_or(abs(x - v) <= 0.01 * v) as traces from g, v group by doc_id, token),
per as (select doc_id, count(*) as checked, count(*) filter (not traces) as ungrounded from tr group by doc_id)
select doc_id, coalesce(checked, 0) as checked, coalesce(ungrounded, 0) as ungrounded, round(1 - coalesce(ungrounded / checked, 0), 6) as groundedness, coalesce(ungrounded, 0) = 0 as ok from documents left join per using (doc_id)""")
def number_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each document, whole ones from 100 on too, against the prices of parts and their computed mean."""
    prices = read(spark, sf_dir, "part").select(F.col("p_retailprice").cast("double").alias("value"))
    allowed = prices.unionByName(prices.agg(F.avg("value").alias("value")))
    return V.number_check(read(spark, sf_dir, "documents").select("doc_id", "text"), allowed, "doc_id")


_PADDED = "list_transform(string_split(text, chr(10)), lambda x, i: '  ' || i || ' ' || x || ' ' || (i % 12) || '  ')"


def padded(text: Column) -> Column:
    """Lines with white space around them, and digits at both ends."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(" "), x, F.lit(" "), ((i + 1) % 12).cast("string"), F.lit("  ")))


@query(f"""select doc_id, substr(array_to_string(list_filter(list_transform({_PADDED}, lambda x: trim(x)), lambda x: x <> '')[1:5], ' '), 1, 200) as description from documents""")
def padded_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ingest.table_description(F.array_join(padded(F.col("text")), "\n")).alias("description"))


@query(f"""select doc_id, array_to_string(list_transform(list_filter(list_transform({_PADDED}, lambda x: trim(x)), lambda x: x <> '')[1:10], lambda x: left(x, 40)), '|') as labels from documents""")
def padded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = review.request_columns(F.array_join(padded(F.col("text")), "\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(columns, lambda x: x["label"]), "|").alias("labels"))
