"""Ingest: boilerplate, classes, years, chunks, ids, dedup, summaries, receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import ingest, scope
from folioscope.plans.registry import query, read

LINES = """lines as (
  select doc_id, source, u.i::int - 1 as elem_ix, u.x as text
  from documents, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) as t(u0), lateral (select u0[1] as i, u0[2] as x) u
)"""


def q(text: str) -> str:
    """As a string of SQL."""
    return "'" + text.replace("'", "''") + "'"


def _boilerplate_sql(text: str) -> str:
    residue = reduce(lambda t, p: f"regexp_replace({t}, {q(p)}, ' ', 'g')", (P.PRINT_TIMESTAMP, P.BARE_URL, P.PAGE_N_OF_M), f"trim({text})")
    return f"(coalesce({text} = '', true) or (length(trim({text})) <= {P.CHROME_MOST_CHARS} and length(regexp_replace({residue}, {q(P.SEPARATORS)}, '', 'g')) < {P.CHROME_LEAST_RESIDUE}))"


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "null"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        return q(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)

    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({names})"


@query(f"with {LINES} select doc_id, 0::bigint as by_category, count(*) filter ({_boilerplate_sql('text')}) as by_pattern, count(*) filter (not {_boilerplate_sql('text')}) as kept, count(*) as total from lines group by doc_id")
def boilerplate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.boilerplate_report(ingest.lines(read(spark, sf_dir, "documents")))


CHROME = ["Page 3 of 7", "https://example.org/a/b", "12/31/2023, 10:05 am", "", "9.1 Governing Law", "Page 1 of 2 | https://x.y | the clause on payments"]


@query(f"select text, {_boilerplate_sql('text')} as chrome from {sql_values([(c,) for c in CHROME], 'text')}")
def boilerplate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "text string", [(c,) for c in CHROME]).select("text", ingest.is_boilerplate(F.col("text")).alias("chrome"))


def _hint(names: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(name, {q(n)})" for n in names) + ")"


@query(f"""with {LINES}, per as (
  select doc_id, count(*) filter (regexp_matches(trim(text), {q(P.HEADING)})) / greatest(count(*), 1)::double as h,
    sum(length(text) - length(replace(text, '$', ''))) / greatest(count(*), 1)::double as d, lower(first(source)) as name
  from lines where trim(text) <> '' group by doc_id),
flags as (select *, (h >= 0.15 and d < 0.08) or ({_hint(P.LEGAL_NAMES)} and h >= 0.05 and d < 0.10) as legal, (d >= 0.10 and h < 0.05) or ({_hint(P.FINANCIAL_NAMES)} and d >= 0.05) as fin from per)
select doc_id, round(h, 6) as head_ratio, round(d, 6) as dollar_density,
  case when legal and not fin then 'legal_contract' when fin and not legal then 'financial_filing' when legal and fin then 'mixed' else 'generic' end as doc_type from flags""")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sourced = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("elem_ix", "text"))
    return ingest.classify(sourced, "source")


FILES = [
    ("amzn-20221231.pdf", []), ("goog-20211231.pdf", []), ("msft-10k_20210630.htm.pdf", []), ("0000950170-23-035122.pdf", []),
    ("0000950170-23-035122.pdf", ["2021", "2022", "2023"]), ("annual_report_FY2023.pdf", []), ("acme-fy23-10k.pdf", []),
    ("Tesla Annual Report 2022.pdf", []), (None, ["Year Ended December 31, 2023", "2022"]), ("report-1889.pdf", ["1985", None]),
]


def _fy_sql(name: str) -> str:
    year = lambda p, g: f"try_cast(nullif(regexp_extract({name}, {q(p)}, {g}), '') as int)"
    inside = lambda y: f"case when {y} between {P.YEAR_MIN} and {P.YEAR_MAX} then {y} end"
    tag = f"(case when length(regexp_extract({name}, {q(P.NAME_FY)}, 1)) = 2 then {year(P.NAME_FY, 1)} + 2000 else {year(P.NAME_FY, 1)} end)"
    return f"coalesce({inside(year(P.NAME_DATE, 2))}, {inside(tag)}, {inside(year(P.NAME_YEAR, 2))})"


@query(f"""select name, len(periods) as n_periods, coalesce({_fy_sql('name')}, list_max(list_transform(periods, lambda p: try_cast(nullif(regexp_extract(p, {q(P.NAME_YEAR)}, 2), '') as int)))) as fiscal_year
from {sql_values(FILES, 'name, periods')}""")
def fiscal_year_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = values(spark, "name string, periods array<string>", FILES)
    return files.select("name", F.size("periods").cast("long").alias("n_periods"), ingest.fiscal_year(F.col("name"), F.col("periods")).alias("fiscal_year"))


@query(f"""with {LINES}, marked as (select *, (sum(case when text like 'The%' or text like '%:' then 1 else 0 end) over (partition by doc_id order by elem_ix))::bigint as chunk_ix from lines)
select doc_id, chunk_ix, count(*) as n_elements, md5(string_agg(text, chr(10) order by elem_ix)) as text_md5 from marked group by doc_id, chunk_ix""")
def line_chunks_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    chunks = ingest.marked_chunks(ingest.lines(read(spark, sf_dir, "documents")), text.startswith("The") | text.endswith(":"))
    return chunks.select("doc_id", "chunk_ix", "n_elements", F.md5("text").alias("text_md5"))


_BARE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"""with recursive {LINES}, e as (select doc_id, {_BARE} as t, regexp_matches(text, {q(P.HEADING)}) as heads, elem_ix // 10 + 1 as page, row_number() over (partition by doc_id order by elem_ix) as ix from lines where {_BARE} <> ''),
f as (select doc_id, ix, 1 as piece, length(t) + 1 as size from e where ix = 1
 union all select doc_id, ix, piece + opens::int, case when opens then 0 else size end + length(t) + 1 from (select e.doc_id, e.ix, e.t, f.piece, f.size, f.size >= 3000 or (e.heads and f.size >= 40) as opens from f join e on e.doc_id = f.doc_id and e.ix = f.ix + 1)),
g as (select doc_id, piece, arg_min(page, ix)::int as page_number, arg_min(left(t, 120), ix) filter (heads) as heading, string_agg(t, chr(10) order by ix) as text from f join e using (doc_id, ix) group by all)
select doc_id, row_number() over (partition by doc_id order by piece)::int as chunk_index, heading, page_number, md5(text) as text from g where length(text) >= 10""")
def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = ingest.lines(read(spark, sf_dir, "documents")).withColumn("page_number", F.floor(F.col("elem_ix") / 10).cast("int") + 1)
    return ingest.clause_chunks(elements).withColumn("text", F.md5("text"))


@query(f"""with recursive {LINES}, p as (select doc_id, length(text) < 40 as title, substr(text, (start + 1)::bigint, 3000) as t, row_number() over (partition by doc_id order by elem_ix, start) as ix from (select *, unnest(range(0, length(text), 3000)) as start from lines)),
f as (select doc_id, ix, 1 as piece, length(t) as size from p where ix = 1
 union all select doc_id, ix, piece + opens::int, case when opens then 0 else size + 2 end + length(t) from (select p.doc_id, p.ix, p.t, f.piece, f.size, f.size >= 2400 or f.size + length(p.t) + 2 > 3000 or (p.title and f.size >= 500) as opens from f join p on p.doc_id = f.doc_id and p.ix = f.ix + 1))
select doc_id, piece::int as chunk_index, md5(string_agg(t, chr(10) || chr(10) order by ix)) as text from f join p using (doc_id, ix) group by doc_id, piece""")
def title_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.length("text") < 40, "Title").otherwise("NarrativeText")
    return ingest.title_chunks(ingest.lines(read(spark, sf_dir, "documents")).withColumn("category", kind)).withColumn("text", F.md5("text"))


@query(f"""with {LINES}, n as (select *, row_number() over (partition by doc_id order by elem_ix)::int as chunk_index from lines)
select doc_id, chunk_index, sha1(concat_ws('::', source, 'text', chunk_index::varchar, text)) as chunk_id from n where length(trim(text)) >= 10""")
def chunk_ids_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("elem_ix", "text"))
    return ingest.numbered_chunks(lines).select("doc_id", "chunk_index", ingest.stable_id(F.col("source"), F.lit("text"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


@query("""select doc_id, sha256(text) as content_hash, coalesce(source, 'unknown') || '::' || sha256(text) as vector_id
from (select *, row_number() over (partition by sha256(text) order by doc_id) as n from documents) where n = 1""")
def dedup_exact_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup_exact(read(spark, sf_dir, "documents")).select("doc_id", "content_hash", "vector_id")


@query(f"""with {LINES}, bare as (select doc_id, elem_ix, trim(text) as text from lines where trim(text) <> ''),
used as (select *, coalesce(sum(length(text)) over (partition by doc_id order by elem_ix rows between unbounded preceding and 1 preceding), 0)::bigint as used from bare)
select doc_id, left(string_agg(left(text, 400 - used), ' ' order by elem_ix), 400) as summary from used where used < 400 group by doc_id""")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.extractive_summary(ingest.lines(read(spark, sf_dir, "documents")))


@query("""with first as (select *, row_number() over (partition by label order by vec_id) as n from embeddings),
x as (select label, unnest(range(0, 64))::int as dim, unnest(embedding)::double as x from first where n <= 50)
select label, dim, round(avg(x), 6) as mean from x group by label, dim""")
def topic_centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.centroids(read(spark, sf_dir, "embeddings"), "label", "vec_id").withColumn("mean", F.round("mean", 6))


@query("""select doc_id, case when n_chars <= 0 then 'auto' when n_chars // 2000 + 1 <= 10 then 'fast' when n_chars / (n_chars // 2000 + 1) >= 1900 then 'fast' else 'hi_res' end as strategy,
  case when n_chars * 100 < 500000 then 'fast' when n_chars * 100 < 5000000 then 'normal' else 'heavy' end as queue from documents""")
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("pages", F.when(F.col("n_chars") <= 0, 0).otherwise(F.floor(F.col("n_chars") / 2000) + 1))
    density = (F.col("n_chars") / F.col("pages")) - 1800  # so that the generated texts fall on both sides of the limit
    return docs.select("doc_id", ingest.parse_strategy(F.lit("pdf"), F.col("pages"), density).alias("strategy"), ingest.size_queue(F.col("n_chars") * 100).alias("queue"))


IMPORTS = [("a.pdf", True), ("b.DOCX", True), ("c.exe", True), ("d.txt", False), ("e", True), ("f.md", True), (None, True)]
SUPPORTED = ("pdf", "docx", "pptx", "txt", "xlsx", "md")


@query(f"""select case when coalesce(lower(regexp_extract(name, '[.]([^.]+)$', 1)), '') not in ({', '.join(map(q, SUPPORTED))}) then 'skipped' when not fetched then 'error' else 'queued' end as status, count(*) as files
from {sql_values(IMPORTS, 'name, fetched')} group by 1""")
def import_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = values(spark, "name string, fetched boolean", IMPORTS)
    extension = F.coalesce(F.lower(F.regexp_extract("name", "[.]([^.]+)$", 1)), F.lit(""))
    status = F.when(~extension.isin(*SUPPORTED), "skipped").when(~F.col("fetched"), "error").otherwise("queued")
    return files.groupBy(status.alias("status")).agg(F.count("*").alias("files"))


_TEXT = reduce(lambda t, p: f"regexp_replace({t}, {q(p)}, ' ', 'g')", (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"), "html")
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, {q(_entity)}, {q(_char)})"


@query(f"select page_id, trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')) as text from pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", ingest.html_to_text(F.col("html")).alias("text"))


@query(f"""with {LINES} select doc_id, case when length(text) > 0 then 'text' end as kind, count(*) as elements from lines group by 1, 2""")
def element_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ingest.lines(read(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id", ingest.element_kind(F.lit("NarrativeText"), F.col("text")).alias("kind")).agg(F.count("*").alias("elements"))


@query("""select doc_id, left(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], ' '), 200) as description from documents""")
def table_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ingest.table_description(F.col("text")).alias("description"))


@query("""select source, count(*) as chunks, min(doc_id) as first_doc, count(distinct sha256(text)) as distinct_texts,
  sum(case when doc_id // 100 = 0 then 1 else 0 end)::bigint as workspace_0 from documents group by source""")
def scope_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = read(spark, sf_dir, "documents").withColumns({"workspace_id": F.floor(F.col("doc_id") / 100), "collection_id": F.col("source"), "content_hash": F.sha2("text", 256)})
    return stamped.groupBy(F.col("collection_id").alias("source")).agg(
        F.count("*").alias("chunks"), F.min("doc_id").alias("first_doc"), F.countDistinct("content_hash").alias("distinct_texts"), F.count_if(F.col("workspace_id") == 0).alias("workspace_0")
    )


@query("""with p as (select doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as page_no, unnest(string_split(text, chr(10) || chr(10))) as text from documents)
select doc_id, count(*) as pages, round(avg(length(text)), 6) as density from p where page_no < 5 group by doc_id""")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text as pages, the first five sampled."""
    pages = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("page_no", "text"))
    return ingest.text_density(pages, "doc_id", 5)


@query("select doc_id from documents left join labels using (doc_id) where quality is null or quality <> 0")
def tables_of_legal_prose_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of label 0 stand for those that were classified as legal prose."""
    classes = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "legal_contract").otherwise("generic").alias("doc_type"))
    return ingest.without_legal_tables(read(spark, sf_dir, "documents").select("doc_id"), classes)


@query("select doc_id from documents where lower(trim(lang)) in ('en', 'de')")
def instrument_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for instrument types."""
    return scope.of_instruments(read(spark, sf_dir, "documents").withColumn("instrument_type", F.col("lang")), ["EN ", "de"]).select("doc_id")
