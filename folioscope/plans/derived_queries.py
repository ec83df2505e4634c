"""Rules applied to rows made of the tables: lines, words and sentences of documents, orders, line items and events.

The SQL restates each rule; cases with answers known by hand stand beside the operators' other queries and in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import corpus as C
from folioscope.operators import govern as G
from folioscope.operators import ingest
from folioscope.operators import kernel as K
from folioscope.operators import retrieval as R
from folioscope.operators import review
from folioscope.operators import scope as S
from folioscope.operators import tables as T
from folioscope.operators import verify as V
from folioscope.plans.ingest_queries import q, values
from folioscope.plans.registry import query, read
from folioscope.plans.retrieval_queries import COS, COSINE, SCORED, nearest
from folioscope.sources import files

LINES = "ln as (select distinct trim(unnest(string_split(text, chr(10)))) as label from documents)"
WORDS = "wd as (select distinct unnest(string_split_regex(text, '[ \\n]')) as word from documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lines of all documents."""
    return read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("label")).select(F.trim("label").alias("label")).distinct()


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("word")).distinct()


_COUNT = "(length(label) - length(replace(label, '{0}', '')))"


@query(f"""with {LINES} select md5(label) as label_md5, label <> '' and len(string_split_regex(label, '\\s+')) <= 6 and not contains(label, ',') and not (suffix(label, '.') and not suffix(label, '..')) as lineitem,
 regexp_matches(label, {q(P.AGGREGATE_LABEL)}) as aggregate_request,
 label <> '' and not regexp_matches(label, {q(P.UNITS_HINT)}) and {_COUNT.format('(')} = {_COUNT.format(')')} and len(string_split_regex(label, '\\s+')) <= 6 and not suffix(label, '.') and not (prefix(label, '(') and suffix(label, ')')) as header from ln""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return lines(spark, sf_dir).select(F.md5(label).alias("label_md5"), S.is_lineitem(label).alias("lineitem"), S.is_aggregate_request(label).alias("aggregate_request"), T.is_section_header(label).alias("header"))


@query(f"""with {LINES} select md5(label) as label_md5, coalesce({', '.join(f"case when contains(lower(label), {q(u)}) then {q(u)} end" for u in P.UNIT_PHRASES)}) as unit from ln""")
def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.md5("label").alias("label_md5"), T.units(F.col("label")).alias("unit"))


_BARE = "trim(regexp_replace(trim(word), '[($),%]', '', 'g'))"


@query(f"""with {WORDS} select md5(word) as word_md5, regexp_matches(trim(word), {q(P.NUMBER_CELL)}) and regexp_matches(trim(word), '\\d') as numeric_cell, regexp_matches(word, {q(P.NOISE_CELL)}) as noise,
 case when {_BARE} = '' then '' when prefix(trim(word), '(') and suffix(trim(word), ')') and not prefix({_BARE}, '-') then '-' || {_BARE} else {_BARE} end as number from wd""")
def word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word")
    return words(spark, sf_dir).select(F.md5(word).alias("word_md5"), T.is_numeric(word).alias("numeric_cell"), T.is_noise(word).alias("noise"), T.normal_number(word).alias("number"))


@query(f"""with {LINES}, y as (select label, try_cast(nullif(regexp_extract(label, '((?:19|20)\\d{{2}})', 1), '') as int) as full_year, try_cast(nullif(regexp_extract(label, '(?i)FY\\s?''?(\\d{{2}})\\b', 1), '') as int) as short from ln)
select md5(label) as label_md5, coalesce(full_year, short + case when short < 70 then 2000 else 1900 end) as yr from y""")
def line_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.md5("label").alias("label_md5"), K.period_year(F.col("label")).alias("yr"))


_SHORT = "trim(regexp_replace(text, '\\s*\\([^)]*\\)\\s*$', ''))"
_CUT = "trim(regexp_replace(text, '(?i)\\s+(in|for|of|during|at|under|within|between)\\s+\\S.*$', ''))"


@query(f"select conv_id, turn, case when {_SHORT} not in ('', text) then {_SHORT} when {_CUT} not in ('', text) then {_CUT} end as broader from (select conv_id, turn, replace(text, chr(10), ' ') as text from conversations)")
def message_broadening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as questions, on one line."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", R.broadened(F.replace("text", F.lit("\n"), F.lit(" "))).alias("broader"))


_HAY = "lower(coalesce(label, '') || ' ' || '')"


@query(f"with {LINES} select md5(label) as label_md5, case {' '.join(f'when regexp_matches({_HAY}, {q(p)}) then {q(k)}' for p, k in P.UNSIGNABLE)} end as excluded from ln")
def line_signability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.md5("label").alias("label_md5"), S.unsignable(F.col("label"), F.lit(None).cast("string")).alias("excluded"))


_SPLIT = "replace(text, '. ', '.' || chr(10) || '## ')"


@query(f"""with l as (select doc_id, unnest(string_split({_SPLIT}, chr(10))) as line, generate_subscripts(string_split({_SPLIT}, chr(10)), 1) as ix from documents),
n as (select *, sum(case when prefix(line, '## ') then 1 else 0 end) over (partition by doc_id order by ix) as section_ix from l)
select doc_id, section_ix::bigint as section_ix, md5(max(line) filter (prefix(line, '## '))) as header_md5, md5(coalesce(string_agg(line, chr(10) order by ix) filter (not prefix(line, '## ')), '')) as body_md5 from n group by doc_id, section_ix""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which every sentence but the first opens a section."""
    texts = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n## ")).alias("text"))
    found = V.sections(texts, "doc_id")
    return found.select("doc_id", "section_ix", F.md5("header").alias("header_md5"), F.md5("body").alias("body_md5"))


@query("""with a as (select event_id, '## Confidence: ' || (event_id % 130)::varchar as answer, round(value / 100, 4) as g, (event_id % 130)::double as said from events)
select event_id, round(case when said > 1 then said / 100 else said end * g, 6) as confidence, case when said > 1 then said / 100 else said end * g < 0.45 as abstain from a""")
def event_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("## Confidence: "), (F.col("event_id") % 130).cast("string"))
    value, abstain = V.stated_confidence(answer, F.round(F.col("value") / 100, 4))
    return read(spark, sf_dir, "events").select("event_id", value.alias("confidence"), abstain.alias("abstain"))


@query("""with c as (select event_id, event_id % 5 as k, event_id % 3 as n_sources from events)
select event_id, case when k = 0 and n_sources = 0 then 'abstain' when k = 0 then 'found' when k = 1 then 'missing' when k = 2 then 'abstain' else 'error' end as status from c""")
def event_grid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    state = F.when(k == 0, "Found").when(k == 1, "missing").when(k == 2, "ABSTAIN").when(k == 3, "maybe")
    rows = read(spark, sf_dir, "events").select("event_id", state.alias("status"), F.lit("v").alias("value"), (F.col("event_id") % 3).alias("n_sources"))
    return rows.select("event_id", V.grid_status(F.struct("status", "value", "n_sources")).alias("status"))


@query("""with o as (select event_type, case when event_id % 7 = 0 then null else value end as a, round(value, 1) as t from events)
select event_type, count(*) filter (a is not null and abs(a - t) <= 0.005 * abs(t)) as correct, count(*) filter (a is null) as abstained, count(*) filter (a is not null and not abs(a - t) <= 0.005 * abs(t)) as wrong from o group by event_type""")
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against themselves rounded to one decimal; every seventh has no answer."""
    o = V.outcome(F.col("a"), F.col("t"))
    rows = read(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"), F.round("value", 1).alias("t"))
    return rows.groupBy("event_type").agg(F.count_if(o == "CORRECT").alias("correct"), F.count_if(o == "ABSTAINED").alias("abstained"), F.count_if(o == "WRONG").alias("wrong"))


@query("""with s as (select event_type as metric, case when event_id % 5 > 1 then value end as score from events)
select metric, round(avg(score), 4) as mean, count(score) as valid, count(*) - count(score) as missing from s group by metric""")
def event_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of which a fifth is null and a fifth is not a number."""
    k = F.col("event_id") % 5
    score = F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return V.metric_means(read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), score.alias("score")))


@query("""with m as (select event_type || '_recall' as metric, event_id % 2 as half, avg(value) / 100 as value from events where not (event_type = 'click' and event_id % 2 = 1) group by all)
select b.metric, round(b.value, 6) as was, round(n.value, 6) as now, n.value is null or b.value - n.value > 0.05 or n.value < 0.8 as failed from (select * from m where half = 0) b full outer join (select * from m where half = 1) n using (metric)""")
def event_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of even events as the baseline of odd ones; one metric is gone."""
    e = read(spark, sf_dir, "events").where(~((F.col("event_type") == "click") & (F.col("event_id") % 2 == 1)))
    m = e.groupBy(F.concat("event_type", F.lit("_recall")).alias("metric"), (F.col("event_id") % 2).alias("half")).agg((F.avg("value") / 100).alias("value"))
    found = V.regressions(m.where("half = 0"), m.where("half = 1"))
    return found.withColumns({c: F.round(c, 6) for c in ("was", "now")})


@query("""select p_partkey, format('{:,.1f}', p_size::double) || '%' as percent, format('{:,.2f}', p_size::double) || 'x' as multiple, format('{:,.0f}', p_partkey::double * 1000) as amount from part""")
def part_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda v, unit: K.display(v.cast("double"), F.lit(unit))
    return read(spark, sf_dir, "part").select("p_partkey", show(F.col("p_size"), "%").alias("percent"), show(F.col("p_size"), "x").alias("multiple"), show(F.col("p_partkey") * 1000, "").alias("amount"))


_WANTED = ["blue widgt", "small", "zzzz"]


@query(f"""with n as (select distinct p_name as label from part), w as (select unnest({_WANTED}) as want),
l as (select want, label, 1 - levenshtein(lower(label), want)::double / greatest(length(label), length(want)) as likeness from n, w),
r as (select *, row_number() over (partition by want order by likeness desc, label)::int as rank from l where likeness >= 0.5) select want, label, round(likeness, 6) as likeness, rank from r where rank <= 3""")
def part_names_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.close_labels(read(spark, sf_dir, "part").select(F.col("p_name").alias("label")), values(spark, "want string", [(w,) for w in _WANTED]))
    return found.select("want", "label", F.round("likeness", 6).alias("likeness"), "rank")


@query("""with f as (select user_id as doc, event_id as ix, (event_id * 7919 % 11 % 3)::int as width from events), b as (select *, last_value(nullif(width, 0) ignore nulls) over (partition by doc order by ix rows between unbounded preceding and 1 preceding) as prior from f),
s as (select *, case when width = 0 then prior is null else prior is null or prior <> width end as starts from b) select doc, ix, width, sum(starts::int) over (partition by doc order by ix)::bigint as run from s""")
def stitched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the table fragments of a document."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("ix"), (F.col("event_id") * 7919 % 11 % 3).cast("int").alias("width"))
    return T.stitched(rows).select("doc", "ix", "width", "run")


@query("""with l as (select user_id as table_id, event_id as r, '| ' || event_type || ' | ' || event_id::varchar || ' |' as line from events) select table_id, string_agg(line, chr(10) order by r) as text from l group by table_id""")
def event_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the rows of a table."""
    item = F.posexplode(F.array("event_type", F.col("event_id").cast("string"))).alias("c", "text")
    return T.markdown(read(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.col("event_id").alias("r"), item))


_NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"


@query(f"""select p_partkey, {_NORM.format('p_name')} <> '' and {_NORM.format('p_type')} <> '' and (contains({_NORM.format('p_name')}, {_NORM.format('p_type')}) or contains({_NORM.format('p_type')}, {_NORM.format('p_name')})) as by_type,
 {_NORM.format('p_name')} <> '' as by_itself from part""")
def same_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", S.same_document(name, F.col("p_type")).alias("by_type"), S.same_document(name, F.concat(F.upper(name), F.lit(".pdf"))).alias("by_itself"))


@query("select o_custkey as doc_id, o_orderkey % 90 as page_number from orders where o_orderkey % 90 between 3 and 5 order by 1, 2 limit 64")
def rows_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows on pages; the 64 of a page range are what one answer reads."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 90).alias("page_number"))
    return S.page_rows(rows, "3-5")


@query("""select page_id, coalesce(nullif(trim(case when page_id % 3 = 0 then url end), ''), nullif(trim(case when page_id % 3 = 1 then ' ' else 'c' || page_id end), ''), 'Image on page ' || case when page_id % 2 = 0 then page_id::varchar end, 'Image') as description from pages""")
def image_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.when(F.col("page_id") % 3 == 0, F.col("url"))
    caption = F.when(F.col("page_id") % 3 == 1, " ").otherwise(F.concat(F.lit("c"), F.col("page_id").cast("string")))
    number = F.when(F.col("page_id") % 2 == 0, F.col("page_id"))
    return read(spark, sf_dir, "pages").select("page_id", ingest.image_description(alt, caption, number).alias("description"))


@query("select event_id, (event_id % 2 = 0)::int + (event_id % 3 = 0)::int + 1 as entries, event_type as kind from events")
def cleaned_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = lambda k: F.when(F.col("event_id") % k == 0, F.lit("x"))
    clean = ingest.clean_metadata(F.create_map(F.lit("a"), given(2), F.lit("b"), given(3), F.lit("kind"), F.col("event_type")))
    return read(spark, sf_dir, "events").select("event_id", F.size(clean).alias("entries"), clean["kind"].alias("kind"))


@query(f"with {SCORED}, r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) select query_id, vec_id, rank as source_id from r where rank <= 7")
def numbered_source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered_sources(nearest(spark, sf_dir, 7)).select("query_id", "vec_id", "source_id")


@query("select event_id from events where event_type <> 'click'")
def cache_without_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.without_namespace(read(spark, sf_dir, "events").withColumnRenamed("event_type", "namespace"), "click").select("event_id")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7)")
def rows_of_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vaults that their nation may read; the orders of nation 7's."""
    grants = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("vault_id"))
    return G.policy_view(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "vault_id"), grants, 7).select("o_orderkey")


@query(f"""with a as (select o_orderkey as series_id, unnest([o_custkey % 7, null, o_custkey % 5, null])::double as value, unnest([1, 2, 3, 4]) as series_ix from orders),
r as (select *, row_number() over (partition by series_id order by value, series_ix) as lo from a where value is not null) select series_id, series_ix::varchar as binding, value from r where lo = 1""")
def smallest_of_gapped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without a value never win."""
    point = F.posexplode(F.array(F.col("o_custkey") % 7, F.lit(None).cast("long"), F.col("o_custkey") % 5, F.lit(None).cast("long"))).alias("at", "v")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series_id"), point)
    series = rows.select("series_id", (F.col("at") + 1).alias("series_ix"), (F.col("at") + 1).cast("string").alias("key"), F.col("v").cast("double").alias("value"))
    return K.extreme(series, False)


CONSTITUTION = [
    ("c", i, t)
    for i, t in enumerate([
        "preamble", "PART III", "FUNDAMENTAL RIGHTS", "14. Equality before law.—The State shall not deny equality.", "1. Subs. by an Act of 1976", "within the territory.", "", "[Art. 31 omitted by an Act]",
        "31. Property.—No person shall be deprived.", "32A. [Validity of laws.] Rep. by Act 3.", "PART IV", "stray line", "36. Definition.—In this Part", "14. Again.—Twice.", "THE FIRST SCHEDULE [Article 1]", "1. Defence.—A list.", "2. Roads",
    ])
]


@query("""select * from (values ('c', 1, 'article', '14', 'III', 'FUNDAMENTAL RIGHTS', 'Equality before law', 'The State shall not deny equality. 1. Subs. by an Act of 1976 within the territory.', false),
('c', 2, 'article', '31', 'III', 'FUNDAMENTAL RIGHTS', 'Property', 'No person shall be deprived.', true), ('c', 3, 'article', '32A', 'III', 'FUNDAMENTAL RIGHTS', 'Validity of laws', 'Rep. by Act 3.', true),
('c', 4, 'article', '36', 'IV', null, 'Definition', 'In this Part', false), ('c', 5, 'schedule', 'Schedule.FIRST', null, null, 'First Schedule', '1. Defence.—A list. 2. Roads', false)) as t(source_key, ix, kind, id, part, part_title, title, text, repealed)""")
def constitution_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known by hand: a footnote, an omitted article, a repealed stub, a repeated id, and numbered lines within a schedule."""
    return C.articles(values(spark, "source_key string, elem_ix int, text string", CONSTITUTION))


@query("""select p_partkey, trim('What is ' || p_name || ' of size ' || coalesce((case when p_size % 2 = 0 then p_size end)::varchar, '') || ' and  worth?') as question from part""")
def rendered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter, one that is null at times, and one that nobody gives."""
    params = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", review.rendered(F.lit("What is {name} of size {size} and {unknown} worth?"), params).alias("question"))


@query("""with l as (select doc_id, list_filter(list_transform(string_split(replace(text, '\n', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:10] as items from documents)
select doc_id, len(items)::int as n_columns, md5(array_to_string(list_transform(items, lambda x: left(x, 40)), '|')) as labels_md5 from l""")
def requested_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as a request list."""
    c = review.request_columns(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(c).alias("n_columns"), F.md5(F.array_join(F.transform(c, lambda x: x["label"]), "|")).alias("labels_md5"))


_TOKS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> ''))"
_SHARE = "len(list_intersect(['apache', 'license', 'version'], {0}))::double / 3"


@query(f"""with p as (select embedding from embeddings where vec_id = 1), d as (select doc_id, source, text, case when doc_id % 2 = 0 then e.embedding end as topic from documents left join embeddings e on e.vec_id = doc_id),
s as (select doc_id, case when topic is not null then {COSINE.format(a='topic', b='p.embedding')} when trim(coalesce(text, '')) = '' then {_SHARE.format(_TOKS.format("regexp_replace(source || ' license.pdf', '[^A-Za-z0-9]+', ' ', 'g')"))} else {_SHARE.format(_TOKS.format('text'))} end as score from d, p),
r as (select doc_id, round(score, 6) as route_score, row_number() over (order by round(score, 9) desc, doc_id)::int as rank from s) select * from r where rank <= 12""")
def routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by topic vector, summary or name, and the twelve that a question goes to."""
    vectors = read(spark, sf_dir, "embeddings")
    docs = read(spark, sf_dir, "documents").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    docs = docs.select("doc_id", F.col("text").alias("summary"), F.concat("source", F.lit(" license.pdf")).alias("filename"), F.when(F.col("doc_id") % 2 == 0, F.col("embedding")).alias("topic"))
    asked = vectors.where("vec_id = 1").select(F.col("embedding").alias("query_vector"))
    found = R.routed(docs.join(F.broadcast(asked), F.lit(True)), F.col("query_vector"), F.lit("apache license version"))  # asked: one row
    top = R.top_per(found.select(F.lit(0).alias("q"), "doc_id", F.round("route_score", 9).alias("score")), ["q"], 12, "doc_id")
    return top.select("doc_id", F.round("score", 6).alias("route_score"), "rank")


@query(f"""with p as (select vec_id as query_id, embedding from embeddings where vec_id % 20 = 0), s as (select p.query_id, e.vec_id, {COS} as score from embeddings e, p where e.vec_id <> p.query_id),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id)::int as rank from s) select query_id, vec_id, rank, round(score, 6) as score from r where rank <= 10""")
def cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asks all others."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = R.dense_top(rows, asked, 11, "vec_id").where("vec_id <> query_id").withColumn("score", F.round("score", 9))
    return R.top_per(near, ["query_id"], 10, "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("""with a as (select *, doc_id % 6 as shape, doc_id % 5 > 0 as grounded from documents)
select doc_id, case when shape = 5 then 'error' when shape = 1 then 'missing' when shape in (0, 2) and grounded then 'found' else 'abstain' end as status,
  case when grounded and shape = 0 then source when grounded and shape = 2 then concat_ws('; ', lang, case when source <> lang then source end) end as value,
  case when shape = 0 then 'non_standard' when shape = 1 then 'missing' else 'none' end as risk,
  case when shape = 3 then 'ambiguous' when shape = 4 then 'unparsed' when not grounded and shape = 0 then 'no_evidence' when not grounded and shape = 2 then 'unparsed' end as abstain_reason from a""")
def grid_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in six shapes made of the documents: an envelope among prose, a fenced one, another shape, one that declines, the text, none."""
    lit, shape = F.lit, F.col("doc_id") % 6
    envelope = F.to_json(F.struct(lit("Found").alias("status"), F.col("source").alias("value"), lit("").alias("quote"), lit("non_standard").alias("risk")))
    other = F.to_json(F.struct(F.struct(F.col("lang").alias("law"), F.array("source", lit(None), "lang").alias("seat")).alias("clause")))
    declined = F.to_json(F.struct(F.concat(lit("Cannot verify "), F.coalesce("source", lit(""))).alias("clause")))
    answer = F.when(shape == 0, F.concat(lit("Here: ```json "), envelope, lit("```"))).when(shape == 1, '```json{"status": "missing", "value": null}```')
    answer = answer.when(shape == 2, other).when(shape == 3, declined).when(shape == 4, F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), (F.col("doc_id") % 5).cast("int").alias("n_sources"), (shape == 5).alias("degraded"))
    return V.grid_cells(rows).select("doc_id", "status", "value", "risk", "abstain_reason")


@query("""select doc_id as result_id, doc_id as doc, (doc_id % 100)::varchar as raw, contains(text, (doc_id % 100)::varchar) as corroborated from documents""")
def figure_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a number made of the document's id stands in one of its lines."""
    docs = read(spark, sf_dir, "documents")
    figures = docs.select(F.col("doc_id").alias("result_id"), F.col("doc_id").alias("doc"), (F.col("doc_id") % 100).cast("string").alias("raw"))
    return review.corroborated(figures, docs.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("text")))
