"""Tables: confidence, noise, periods, fidelity, statements, word geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import ingest
from folioscope.operators import tables as T
from folioscope.plans.ingest_queries import LINES, q, sql_values, values
from folioscope.plans.registry import query, read

TABLES = {
    "income": [["", "2021", "2022", ""], ["Net sales", "$", "469,822", "513,983"], ["Operating income:", "", "", ""], ["AWS", "18,532", "22,841", "—"], ["Change", "7%", "(1)%", ""]],
    "layout": [["A paragraph", "of words"], ["and more", "words here"]],
    "thin": [["x", "1"]],
}
CELLS = [(t, r, c, x) for t, rows in TABLES.items() for r, row in enumerate(rows) for c, x in enumerate(row)]
CELLS_SQL = f"cells as (select table_id, r, c, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as text from {sql_values(CELLS, 'table_id, r, c, text')})"
NOISE = f"regexp_matches(text, {q(P.NOISE_CELL)})"
NUMERIC = f"(regexp_matches(text, {q(P.NUMBER_CELL)}) and regexp_matches(text, '\\d'))"
WIDTHS = f"""per as (select table_id, r, count(*) filter (c > 0 and not {NOISE}) as n from cells group by all),
common as (select table_id, n, count(*) as k, min(r) as f from per where n > 0 group by all),
widths as (select table_id, n as width from (select *, row_number() over (partition by table_id order by k desc, f) as i from common) where i = 1)"""


def cells(spark: SparkSession) -> DataFrame:
    return values(spark, "table_id string, r int, c int, text string", CELLS)


@query(f"""with {CELLS_SQL}, {WIDTHS},
shape as (select table_id, count(*) as rows_, max(width) as width, coalesce(count(*) filter (n > 0 and n > width)::double / nullif(count(*) filter (n > 0), 0), 0) as ragged from per left join widths using (table_id) group by table_id),
content as (select table_id, count(*) filter (r > 0 and text <> '') as cells_, count(*) filter (r > 0 and text <> '' and {NUMERIC}) as num, bool_or(c = 0 and text <> '' and not {NUMERIC}) as labelled from cells group by table_id),
scored as (select table_id, round(case when rows_ < 2 or width is null or cells_ < 3 then 0.0 else 0.4 * greatest(0.0, 1 - ragged / 0.34) + 0.4 * (case when num / cells_::double / 0.25 >= 1 then 1.0 else num / cells_::double / 0.25 * 0.5 end) + 0.2 * (case when labelled then 1.0 else 0.4 end) end::double, 6) as confidence from shape join content using (table_id))
select table_id, confidence, confidence >= 0.6 as accepted from scored""")
def table_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.confidence(cells(spark))


@query(f"with {CELLS_SQL} select table_id, r, c, text from cells where (table_id, c) in (select (table_id, c) from cells group by table_id, c having bool_or(not {NOISE}))")
def noise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.without_noise_columns(cells(spark)).select("table_id", "r", "c", T.clean(F.col("text")).alias("text"))


@query(f"""with {CELLS_SQL}, n as (select *, text = '$' and coalesce(lead({NUMERIC}) over (partition by table_id, r order by c), false) as lone from cells)
select table_id, r, (row_number() over (partition by table_id, r order by c) - 1)::int as c, text from n where not lone""")
def merged_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_merged_currency(cells(spark).withColumn("text", T.clean(F.col("text")))).select("table_id", "r", "c", "text")


@query("""select * from (values ('income', 1, '', 'Net sales', 1, '469,822'), ('income', 1, '', 'Net sales', 2, '513,983'), ('income', 3, 'Operating income', 'AWS', 1, '18,532'), ('income', 3, 'Operating income', 'AWS', 2, '22,841'),
('income', 4, 'Operating income', 'Change', 1, '7%'), ('income', 4, 'Operating income', 'Change', 2, '(1)%'), ('layout', 0, '', 'A paragraph', 1, 'of words'), ('layout', 1, '', 'and more', 1, 'words here'), ('thin', 0, '', 'x', 1, '1')) as t(table_id, r, section, label, slot, value)""")
def built_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values fall right-aligned into the columns, and a label without values scopes what follows."""
    return T.built_rows(cells(spark), T.value_widths(cells(spark).withColumn("text", T.clean(F.col("text")))))


PERIODS = [(1, 2, ["2023", "2022"], [], []), (2, 2, [], ["2021", "2020"], []), (3, 3, ["2023", "2022"], [], [2]), (4, 3, ["2023"], [], []), (5, 3, ["2022", "2021"], ["2019"], [1])]


@query("""select * from (values (1, ['2023', '2022']), (2, ['2021', '2020']), (3, ['2023', '2022', 'pct_change']), (4, []), (5, ['2022', 'pct_change', '2021'])) as t(id, periods)""")
def resolved_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, width int, page array<string>, grid array<string>, pct array<int>", PERIODS)
    return rows.select("id", T.resolved_periods(F.col("width"), F.col("page"), F.col("grid"), F.col("pct")).alias("periods"))


@query(f"""with {CELLS_SQL} select table_id, c from cells where r > 0 and c > 0 and text <> '' group by table_id, c having avg(case when regexp_replace(text, '\\)+$', '') like '%\\%' escape '\\' then 1.0 else 0.0 end) >= 0.3""")
def percent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.percent_columns(cells(spark), 0.3)


HEADERS = [("Revenue:",), ("(In millions)",), ("The following table presents our net sales by segment",), ("Cost of revenue (net",), ("AWS",), ("Refer to notes.",), ("",), (None,)]
_H = "trim(coalesce(label, ''))"


@query(f"""select label, {_H} <> '' and not regexp_matches({_H}, {q(P.UNITS_HINT)}) and length({_H}) - length(replace({_H}, '(', '')) = length({_H}) - length(replace({_H}, ')', ''))
 and len(regexp_split_to_array({_H}, '\\s+')) <= 6 and not suffix({_H}, '.') and not ({_H} like '(%' and suffix({_H}, ')')) as header,
 {_H} = '' or (len(regexp_split_to_array({_H}, '\\s+')) <= 9 and not regexp_matches({_H}, '[A-Za-z],') and not (suffix({_H}, '.') and not suffix({_H}, '..'))) as row_label from {sql_values(HEADERS, 'label')}""")
def label_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return values(spark, "label string", HEADERS).select("label", T.is_section_header(label).alias("header"), T.is_row_label(label).alias("row_label"))


VALUE = q(T.VALUE_TOKEN)
_NORM = "(case when trim(regexp_replace(t, '[($),%]', '', 'g')) = '' then '' when t like '(%' and suffix(t, ')') and not trim(regexp_replace(t, '[($),%]', '', 'g')) like '-%' then '-' || trim(regexp_replace(t, '[($),%]', '', 'g')) else trim(regexp_replace(t, '[($),%]', '', 'g')) end)"


@query(f"""with {LINES}, tk as (select doc_id, elem_ix, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '' and t <> '$') as toks from lines where not contains(lower(text), 'http')),
x as (select *, length(regexp_extract(array_to_string(list_transform(toks, lambda t: case when regexp_matches(t, {VALUE}) then '1' else '0' end), ''), '(1*)$', 1)) as tail from tk),
y as (select *, list_filter(list_transform(toks[len(toks) - tail + 1:], lambda t: {_NORM}), lambda n: n <> '') as tail_numbers, list_filter(list_transform(list_filter(toks, lambda t: regexp_matches(t, {VALUE})), lambda t: {_NORM}), lambda n: n <> '') as numbers from x where tail >= 2),
d as (select * from y where len(list_filter(tail_numbers, lambda n: not coalesce(try_cast(n as double) = floor(try_cast(n as double)) and (try_cast(n as double) between 1900 and 2100 or try_cast(n as double) between 0 and 31), false))) > 0),
n as (select distinct doc_id, elem_ix, unnest(numbers) as number from d),
pool as (select distinct doc_id, unnest(list_filter(list_transform(string_split(text, ' '), lambda t: {_NORM}), lambda n: n <> '' and length(n) % 2 = 0)) as number from documents),
missing as (select doc_id, count(*) as uncovered, count(distinct elem_ix) as lines_uncovered from n where (doc_id, number) not in (select (doc_id, number) from pool) group by doc_id)
select doc_id, count(*) as data_lines, coalesce(max(uncovered), 0)::bigint as uncovered, coalesce(max(lines_uncovered), 0)::bigint as lines_uncovered, case when coalesce(max(uncovered), 0) = 0 then 'good' else 'partial' end as grade from d left join missing using (doc_id) group by doc_id""")
def fidelity_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool lacks, on purpose, the numbers of odd length."""
    docs = read(spark, sf_dir, "documents")
    pool = docs.select("doc_id", F.explode(F.split("text", " ")).alias("t")).select("doc_id", T.normal_number(F.col("t")).alias("number")).where("number <> '' and length(number) % 2 = 0").distinct()
    return T.fidelity(ingest.lines(docs), pool)


WORDS = [
    ("d", 1, *w)
    for w in [
        ("2022", 200.0, 220.0, 10.0), ("2023", 260.0, 280.0, 10.4), ("Net", 20.0, 35.0, 30.0), ("sales:", 36.0, 60.0, 30.1),
        ("AWS", 30.0, 50.0, 42.0), ("$", 190.0, 195.0, 42.0), ("80,096", 200.0, 220.0, 42.2), ("90,757", 260.0, 280.0, 42.1),
        ("North", 30.0, 50.0, 54.0), ("America", 52.0, 80.0, 54.0), ("(1)", 82.0, 88.0, 54.0), ("315,880", 200.0, 220.0, 54.0), ("—", 260.0, 270.0, 54.2),
        ("Subtotal", 30.0, 60.0, 66.0), ("395,976", 200.0, 220.0, 69.0008), ("443,585", 260.0, 280.0, 69.0), ("Leases", 30.0, 50.0, 84.0), ("2.18", 60.0, 70.0, 84.0), ("1,234", 200.0, 220.0, 84.0), ("1,500", 260.0, 280.0, 84.0),
    ]
]


def words(spark: SparkSession) -> DataFrame:
    return values(spark, "doc string, page int, text string, x0 double, x1 double, top double", WORDS)


@query("""select * from (values ('d', 1, ['2022', '2023'])) as t(doc, page, years)""")
def header_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.header_years(words(spark))


@query("""select * from (values ('d', 1, 1, 'Net sales', 'AWS', ['80,096', '90,757']), ('d', 1, 3, 'Net sales', 'Subtotal', ['395,976', '443,585']), ('d', 1, 4, 'Net sales', 'Leases 2.18', ['1,234', '1,500'])) as t(doc, page, line, section, label, values)""")
def geometry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split subtotals, nil dashes, a note reference and a footnote mark; the dash at a line's end is no value by itself."""
    return T.scoped_rows(T.lines_from_words(words(spark)))


FRAGMENTS = [("d", 1, 2), ("d", 2, 0), ("d", 3, 2), ("d", 4, 3), ("d", 5, 3), ("e", 1, 0), ("e", 2, 2)]


@query("""select * from (values ('d', 1, 2, 1::bigint), ('d', 2, 0, 1), ('d', 3, 2, 1), ('d', 4, 3, 2), ('d', 5, 3, 2), ('e', 1, 0, 1), ('e', 2, 2, 2)) as t(doc, ix, width, run)""")
def stitched_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stitched(values(spark, "doc string, ix int, width int", FRAGMENTS))


ROWS = [("s", r, label, 3) for r, label in enumerate(["Revenue", "Cost of sales", "Gross margin", "Operating income", "Net income", "Cash", "Other"])] + [("n", 0, "Leases", 2), ("n", 1, "Rent", 2)]


@query("select * from (values ('s', true), ('n', false)) as t(table_id, statement)")
def statement_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.looks_like_statement(values(spark, "table_id string, r int, label string, n_periods int", ROWS))


@query("""with t as (select source, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as found from documents), s as (select source, doc_id, round(len(list_intersect(['apache', 'license', 'version'], found)) / 3.0::double, 6) as relevance from t),
r as (select *, row_number() over (partition by source order by relevance desc, doc_id) as n from s) select source, doc_id, relevance from r where n <= 3""")
def table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("table_id"), F.round(T.relevance(F.lit("apache license version"), F.col("text")), 6).alias("relevance"))
    return T.selected(docs, per_doc=3).select(F.col("doc").alias("source"), F.col("table_id").alias("doc_id"), "relevance")


@query("""select 'income' as table_id, 'Financial table (page 7) (in millions) across 2021, 2022. Segments/groups: Operating income. Line items: Net sales; AWS; Change' as caption""")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.built_rows(cells(spark).where("table_id = 'income'"), T.value_widths(cells(spark).withColumn("text", T.clean(F.col("text")))))
    about = values(spark, "table_id string, page int, units string, periods array<string>", [("income", 7, "in millions", ["2021", "2022"])])
    return T.captions(rows, about)
