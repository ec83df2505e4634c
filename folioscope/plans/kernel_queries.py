"""Table math: inline grids with known answers, and grids made of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import kernel as K
from folioscope.plans.ingest_queries import sql_values, values
from folioscope.plans.registry import query, read

RAW = ["1,234", "(1,234)", "$1,234.5", "45.2%", "(1.1)%", "($1,665)", "(-5)", "—", "-", "", "NM", "n/a", "abc", "$(1,665)", None, " 12 ", "-3.25", "1.2.3"]

_BARE = "trim(raw)"
_UNMARKED = "case when trim(raw) like '%\\%' escape '\\' then trim(left(trim(raw), length(trim(raw)) - 1)) else trim(raw) end"


def parse_sql(raw: str) -> str:
    bare = f"trim({raw})"
    unmarked = f"(case when suffix({bare}, '%') then trim(left({bare}, length({bare}) - 1)) else {bare} end)"
    wrapped = f"regexp_matches({unmarked}, '^\\(.*\\)$')"
    digits = f"regexp_replace(case when {wrapped} then substr({unmarked}, 2, length({unmarked}) - 2) else {unmarked} end, '[,$%\\s]', '', 'g')"
    return f"(case when {bare} not in ('', '-', '—', '–', 'n/a', 'N/A', 'NM') and regexp_matches({digits}, '^-?\\d+(\\.\\d+)?$') then (case when {wrapped} then -try_cast({digits} as double) else try_cast({digits} as double) end) end)"


@query(f"select raw, {parse_sql('raw')} as value from {sql_values([(r,) for r in RAW], 'raw')} union all select '(' || l_extendedprice::varchar || ')', -l_extendedprice from lineitem where l_linenumber = 1")
def parse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "raw string", [(r,) for r in RAW])
    prices = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("("), F.col("l_extendedprice").cast("string"), F.lit(")")).alias("raw"))
    return rows.unionByName(prices).select("raw", K.parse_cell(F.col("raw")).alias("value"))


GRID = [
    (doc, table, ix, section, label, period, p, raw)
    for doc, table, ix, section, label, cells in [
        ("amzn-20231231.pdf", "t1", 0, "AWS", "Net sales", [("2021", "62,202"), ("2022", "80,096"), ("2023", "90,757")]),
        ("amzn-20231231.pdf", "t1", 1, "AWS", "Operating income", [("2021", "18,532"), ("2022", "22,000"), ("2023", "24,631")]),
        ("amzn-20231231.pdf", "t1", 2, "International", "Operating income", [("2021", "(924)"), ("2022", "(7,746)"), ("2023", "(2,656)")]),
        ("amzn-20231231.pdf", "t2", 0, None, "Total net sales", [("2021", "469,822"), ("2022", "513,983"), ("2023", "574,785")]),
        ("amzn-20231231.pdf", "t2", 1, None, "Net income (loss)", [("2021", "33,364"), ("2022", "(2,722)"), ("2023", "30,425")]),
        ("msft-10k_20220630.htm.pdf", "t1", 0, "Revenue", "Total", [("2021", "168,088"), ("2022", "198,270")]),
        ("msft-10k_20220630.htm.pdf", "t2", 0, "Percent of revenue", "Total revenue", [("2022", "14.9")]),
        ("goog-20221231.pdf", "t1", 0, None, "Total revenues", [("2021", "257,637")]),
        ("goog-20221231.pdf", "t1", 1, None, "Google advertising", [("2021", "209,497")]),
    ]
    for p, (period, raw) in enumerate(cells)
]


def grid(spark: SparkSession) -> DataFrame:
    return values(spark, K.CELLS, GRID)


REFS = [(1, "AWS", "Net sales", "2023"), (2, None, "Total net sales", "2022"), (3, "International", "Operating income", "2022"), (4, None, "Operating income", "2022"), (5, None, "Total revenue", "2021"), (6, None, "Unknown", "2021"), (7, None, "Net sales", "2021")]


@query("select * from (values (1, 90757.0::double, 1::bigint, null), (2, null, 2, 'ambiguous'), (3, -7746.0, 1, null), (4, 22000.0, 1, null), (5, null, 2, 'ambiguous'), (6, null, 0, 'cell not found'), (7, null, 0, 'document not in scope')) as t(ref_id, value, n_cells, error)")
def resolve_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers known by hand: totals that two issuers state differently are ambiguous; every ref has a row, the last one asks for a
    document that is not there."""
    refs = values(spark, "ref_id int, want_section string, want_label string, want_period string, want_doc string", [(*r, "nobody.pdf" if r[0] == 7 else None) for r in REFS])
    found = K.find_rows(K.looks_like_total(K.with_value_kind(grid(spark))).drop("value"), refs)
    return K.resolve(found, refs, grid(spark)).select("ref_id", "value", "n_cells", "error")


@query("""with c as (select r_name, n_name, sum(s_acctbal) as v from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)
select r_name as label, case when count(distinct round(v, 4)) = 1 then round(min(v), 2) end as value, case when count(distinct round(v, 4)) > 1 then 'ambiguous' end as error, count(*) as n_cells from c group by r_name""")
def ambiguity_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation states its own balance under its region's label: different values, hence no answer."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    per = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.sum("s_acctbal").alias("value"))
    cells = per.select(F.col("r_name").alias("ref_id"), F.col("n_name").alias("doc"), F.lit("t").alias("table_id"), F.lit(None).cast("string").alias("section"), F.col("r_name").alias("label"), F.col("r_name").alias("want_label"), F.lit("all").alias("period"), F.col("value").cast("string").alias("raw"), "value", F.lit(2).alias("fit"), F.lit("currency").alias("value_kind"), F.lit(None).cast("boolean").alias("is_total"))
    return K.resolve(cells, cells.select("ref_id").distinct()).select(F.col("ref_id").alias("label"), F.round("value", 2).alias("value"), "error", "n_cells")


@query(f"""with c as (select * from {sql_values(GRID, 'doc, table_id, row_ix, section, label, period, period_ix, raw')}),
v as (select *, {parse_sql('raw')} as value from c),
w as (select *, sum(value) over p - value as others, max(abs(value)) over p as largest, count(value) over p as n from v window p as (partition by doc, table_id, period))
select doc, table_id, row_ix, period, case when value is null or n < 2 then null when others <> 0 and abs(value - others) <= 0.02 * abs(others) then true when abs(value) >= largest then true when abs(value) < largest * 0.98 then false end as is_total from w""")
def looks_like_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.looks_like_total(grid(spark)).select("doc", "table_id", "row_ix", "period", "is_total")


YEARLY = "y as (select o_orderpriority as label, year(o_orderdate) as yr, sum(o_totalprice) as v from orders group by 1, 2)"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("v"))


def year_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = yearly(spark, sf_dir)
    b = a.select("label", (F.col("yr") - 1).alias("yr"), F.col("v").alias("next"))
    return a.join(b, ["label", "yr"])


@query(f"with {YEARLY} select a.label, a.yr, 'growth_pct' as op, round((b.v - a.v) / abs(a.v) * 100, 6) as value, '%' as unit, null::varchar as error from y a join y b on a.label = b.label and b.yr = a.yr + 1")
def growth_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_pairs(spark, sf_dir).select("label", "yr", *K.growth_pct(F.col("v"), F.col("next"))).withColumn("value", F.round("value", 6))


@query(f"with {YEARLY} select a.label, a.yr, 'delta' as op, round(b.v - a.v, 2) as value, '' as unit, null::varchar as error from y a join y b on a.label = b.label and b.yr = a.yr + 1")
def delta_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_pairs(spark, sf_dir).select("label", "yr", *K.delta(F.col("v"), F.col("next"))).withColumn("value", F.round("value", 2))


@query("""with m as (select l_returnflag as flag, sum(l_extendedprice * l_discount) as num, sum(l_extendedprice) as den from lineitem group by 1 union all select 'zero', 1.0, 0.0)
select flag, 'margin_pct' as op, case when den <> 0 then round(num / den * 100, 6) end as value, '%' as unit, case when den = 0 then 'denominator is zero' end as error from m""")
def ratio_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("num"), F.sum("l_extendedprice").alias("den"))
    per = per.unionByName(values(spark, "flag string, num double, den double", [("zero", 1.0, 0.0)]))
    none = F.lit(None).cast("string")
    return per.select("flag", *K.ratio(F.col("num"), F.col("den"), none, none, percent=True)).withColumn("value", F.round("value", 6))


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yearly(spark, sf_dir).select(F.col("label").alias("series_id"), F.col("yr").cast("string").alias("key"), F.col("v").alias("value"), F.col("yr").alias("ix"))
    return K.ordered_series(y)


@query(f"""with {YEARLY}, p as (select label, count(*) as n, arg_min(v, yr) as b, arg_max(v, yr) as e from y group by label)
select label as series_id, 'cagr_pct' as op, round((pow(e / b, 1.0 / (n - 1)) - 1) * 100, 6) as value, '%' as unit, null::varchar as error from p""")
def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cagr(price_series(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""with {YEARLY}, r as (select *, row_number() over (partition by label order by v desc, yr) as hi, row_number() over (partition by label order by v, yr) as lo from y)
select label as series_id, 'argmax' as op, yr::varchar as binding, round(v, 2) as value from r where hi = 1 union all select label, 'argmin', yr::varchar, round(v, 2) from r where lo = 1""")
def argmax_argmin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = price_series(spark, sf_dir)
    both = K.extreme(s, True).withColumn("op", F.lit("argmax")).unionByName(K.extreme(s, False).withColumn("op", F.lit("argmin")))
    return both.withColumn("value", F.round("value", 2))


MONTHLY = "m as (select o_orderstatus as series_id, strftime(o_orderdate, '%Y-%m') as key, count(*)::double as value from orders group by 1, 2), o as (select *, row_number() over (partition by series_id order by key)::int as ix from m)"


def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("series_id"), F.date_format("o_orderdate", "yyyy-MM").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return m.withColumn("series_ix", F.row_number().over(Window.partitionBy("series_id").orderBy("key")))


@query(f"""with {MONTHLY}, c as (select series_id, count(*) as candidates, min(ix) filter (value > 70) as up, max(ix) filter (value < 60) as down from o group by series_id)
select c.series_id, 'first_exceeds' as op, candidates, o.key as binding, o.value, case when up is null then 'no period qualifies' end as error from c left join o on o.series_id = c.series_id and o.ix = up
union all select c.series_id, 'last_below', candidates, o.key, o.value, case when down is null then 'no period qualifies' end from c left join o on o.series_id = c.series_id and o.ix = down""")
def first_exceeds_last_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = month_series(spark, sf_dir)
    up = K.crossing(s, 70, True).withColumn("op", F.lit("first_exceeds"))
    return up.unionByName(K.crossing(s, 60, False).withColumn("op", F.lit("last_below")))


@query("""with v as (select n_name as series_id, s_name as key, s_acctbal as value, s_suppkey as ix from supplier join nation on s_nationkey = n_nationkey),
r as (select *, row_number() over (partition by series_id order by value desc, ix)::int as rank from v) select series_id, key, value, rank from r where rank <= 3""")
def rank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_name").alias("series_id"), F.col("s_name").alias("key"), F.col("s_acctbal").alias("value"), F.col("s_suppkey").alias("series_ix"))
    return K.ranked(s, 3).drop("series_ix")


@query(f"""with {MONTHLY} select series_id, count(*) filter (value >= 100) as n_hits, coalesce(string_agg(key, ', ' order by ix) filter (value >= 100), '') as binding, case when count(*) filter (value >= 100) = 0 then 'nothing passes' end as error from o group by series_id""")
def filter_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.filtered(month_series(spark, sf_dir), ">=", 100)


METRICS = [(1, "Net sales", "2023"), (2, "Total net sales", "2022"), (3, "Operating income", "2022"), (4, "Total revenue", "2021"), (5, "Headcount", "2021")]


@query("""select * from (values (1, 'ok', 90757.0::double, 1.15::double), (2, 'ok', 513983.0, 1.15), (3, 'ambiguous', null, 1.0), (4, 'ok', 257637.0, 0.95), (5, 'abstain', null, 0.0)) as t(metric_id, status, value, score)""")
def ground_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ground(grid(spark), values(spark, "metric_id int, want_label string, want_period string", METRICS))


PERIODS = [("2022",), ("FY2022",), ("Dec 31, 2022",), ("FY '23",), ("FY85",), ("col_1",), (None,)]


@query(f"""select period, coalesce(try_cast(nullif(regexp_extract(period, '((?:19|20)\\d{{2}})', 1), '') as int),
 case when try_cast(nullif(regexp_extract(period, '(?i)FY\\s?''?(\\d{{2}})\\b', 1), '') as int) < 70 then 2000 else 1900 end + try_cast(nullif(regexp_extract(period, '(?i)FY\\s?''?(\\d{{2}})\\b', 1), '') as int)) as yr from {sql_values(PERIODS, 'period')}""")
def period_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "period string", PERIODS).select("period", K.period_year(F.col("period")).alias("yr"))


@query("""select o_orderpriority as label, round(sum(o_totalprice) filter (year(o_orderdate) = 1995), 2) as "1995", round(sum(o_totalprice) filter (year(o_orderdate) = 1996), 2) as "1996" from orders group by 1""")
def grid_long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yearly(spark, sf_dir).select(F.lit("d").alias("doc"), F.lit("t").alias("table_id"), F.lit(0).alias("row_ix"), F.lit("").alias("section"), "label", F.col("yr").cast("string").alias("period"), F.round("v", 2).alias("raw"))
    return K.wide(y, ["1995", "1996"]).select("label", "1995", "1996")


@query("""with p as (select year(o_orderdate)::varchar as key, o_orderstatus as doc, count(*)::double as value from orders group by 1, 2), d as (select 'same' as series_id, key, doc, 1.0::double as value from p union all select 'differ', key, doc, value from p union all select 'single', key, doc, value from p where doc = 'O'),
k as (select series_id, key, count(distinct round(value, 4)) as vs, count(distinct doc) as ds, min(value) as value from d group by 1, 2),
e as (select series_id, case when max(vs) > 1 then 'documents disagree' when max(ds) < 2 then 'no shared year' end as error from k group by 1)
select k.series_id, key, case when error is null then value end as value, error from k join e using (series_id)""")
def union_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("string").alias("key"), F.col("o_orderstatus").alias("doc")).agg(F.count("*").cast("double").alias("value"))
    points = p.withColumn("series_id", F.lit("differ")).unionByName(p.withColumns({"series_id": F.lit("same"), "value": F.lit(1.0)})).unionByName(p.where("doc = 'O'").withColumn("series_id", F.lit("single")))
    return K.union_series(points)


WANTED = [("net sale",), ("operating incom",), ("zzzz",)]


@query("""select * from (values ('net sale', 'Net sales', 1), ('net sale', 'Total net sales', 2), ('operating incom', 'Operating income', 1)) as t(want, label, rank)""")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.close_labels(grid(spark), values(spark, "want string", WANTED)).select("want", "label", "rank")


@query("""select * from (values ('%', 13.3::double, '13.3%'), ('x', 1.5, '1.50x'), ('', 90757.0, '90,757')) as t(unit, value, shown)""")
def result_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "unit string, value double", [("%", 13.3), ("x", 1.5), ("", 90757.0)])
    return rows.select("unit", "value", K.display(F.col("value"), F.col("unit")).alias("shown"))


PRICED = "g as (select o_orderstatus as doc, o_orderpriority as label, year(o_orderdate)::varchar as period, round(sum(o_totalprice), 2) as value from orders group by all)"
MODES = "(select distinct label from g) m"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids made of orders: a document per status, a row per priority, a column per year, texts in the cells."""
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("doc"), F.col("o_orderpriority").alias("label"), F.year("o_orderdate").cast("string").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    cells = per.select("doc", F.lit("t1").alias("table_id"), F.ascii(F.substring("label", 1, 1)).alias("row_ix"), F.lit("").alias("section"), "label", "period", F.col("period").cast("int").alias("period_ix"), F.format_number("value", 2).alias("raw"))
    return K.looks_like_total(K.with_value_kind(cells)).drop("value")


def spec_refs(cells: DataFrame) -> DataFrame:
    """A ref to each priority's cell for every document and year; those of 1996 also ask for a mode that nobody has."""
    specs = cells.select("doc", "period").distinct()
    modes = cells.select("label").distinct()
    rows = specs.join(modes, F.lit(True)).unionByName(specs.where("period = '1996'").withColumn("label", F.lit("SPACESHIP")))
    spec = F.concat_ws("/", "doc", "period")
    return rows.select(spec.alias("spec_id"), F.concat_ws("/", spec, "label").alias("ref_id"), F.lit("").alias("want_section"), F.col("label").alias("want_label"), F.col("period").alias("want_period"), F.col("doc").alias("want_doc"))


def resolved_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = priced(spark, sf_dir)
    refs = spec_refs(cells)
    return refs.select("spec_id", "ref_id", "want_label").join(K.resolve(K.find_rows(cells, refs), refs, cells), "ref_id")


SPECS = f"""with {PRICED}, specs as (select distinct doc, period from g), refs as (select doc, period, m.label from specs, {MODES} union all select doc, period, 'SPACESHIP' from specs where period = '1996'),
r as (select refs.doc || '/' || refs.period as spec_id, refs.label, g.value from refs left join g on g.doc = refs.doc and g.period = refs.period and g.label = refs.label)"""


def combined_sql(op: str, value: str) -> str:
    return f"{SPECS} select spec_id, count(*) as n_operands, '{op}' as op, case when count(*) = count(value) then round({value}, 4) end as value, '' as unit, case when count(*) > count(value) then 'cell not found' end as error from r group by spec_id"


@query(combined_sql("sum", "sum(value)"))
def sum_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.combined(resolved_specs(spark, sf_dir), "sum").withColumn("value", F.round("value", 4))


@query(combined_sql("average", "avg(value)"))
def average_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.combined(resolved_specs(spark, sf_dir), "average").withColumn("value", F.round("value", 4))


@query(f"""{SPECS} select a.spec_id, 'difference' as op, round(a.value - b.value, 4) as value, '' as unit, case when a.value is null or b.value is null then 'cell not found' end as error
from (select * from r where label = '2-HIGH') a join (select * from r where label in ('5-LOW', 'SPACESHIP')) b on a.spec_id = b.spec_id""")
def difference_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved_specs(spark, sf_dir)
    a = r.where("want_label = '2-HIGH'").select("spec_id", F.col("value").alias("a"), F.col("error").alias("error_a"))
    b = r.where("want_label in ('5-LOW', 'SPACESHIP')").select("spec_id", F.col("value").alias("b"), F.col("error").alias("error_b"))
    return a.join(b, "spec_id").select("spec_id", *K.difference(F.col("a"), F.col("b"), F.coalesce("error_a", "error_b"))).withColumn("value", F.round("value", 4))


@query(f"""{SPECS}, k as (select spec_id, '2-HIGH' as num, unnest(['5-LOW', '2-HIGH']) as den from (select distinct spec_id from r))
select k.spec_id, den as denominator, 'ratio' as op, case when den <> '2-HIGH' then round(a.value / b.value, 6) end as value, 'x' as unit, case when den = '2-HIGH' then 'same cell' end as error
from k join r a on a.spec_id = k.spec_id and a.label = num join r b on b.spec_id = k.spec_id and b.label = den""")
def ratio_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio of a cell to itself is an error."""
    r = resolved_specs(spark, sf_dir)
    a = r.where("want_label = '2-HIGH'").select("spec_id", F.col("value").alias("a"), F.col("cells").alias("cells_a"))
    b = r.where("want_label in ('5-LOW', '2-HIGH')").select("spec_id", F.col("want_label").alias("denominator"), F.col("value").alias("b"), F.col("cells").alias("cells_b"))
    none = F.lit(None).cast("string")
    both = a.join(b, "spec_id")
    return both.select("spec_id", "denominator", *K.ratio(F.col("a"), F.col("b"), none, none, num_cell=F.col("cells_a"), den_cell=F.col("cells_b"))).withColumn("value", F.round("value", 6))


@query(f"""{SPECS}, e as (select *, row_number() over (partition by spec_id order by value desc, label) as hi, row_number() over (partition by spec_id order by value, label) as lo from r where value is not null)
select spec_id as series_id, 'argmax' as op, label as binding, value from e where hi = 1 union all select spec_id, 'argmin', label, value from e where lo = 1""")
def extremes_over_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity axis: line items of one period, of which those without a value drop out."""
    r = resolved_specs(spark, sf_dir).select(F.col("spec_id").alias("series_id"), F.col("want_label").alias("ix"), F.lit("").alias("section"), F.col("want_label").alias("label"), "value")
    s = K.entity_series(r)
    return K.extreme(s, True).withColumn("op", F.lit("argmax")).unionByName(K.extreme(s, False).withColumn("op", F.lit("argmin")))


@query(f"""with {PRICED}, a as (select unnest(['2-HIGH', '5-LOW', 'SPACESHIP']) as series_id),
k as (select label, period, count(distinct round(value, 4)) as vs, count(distinct doc) as ds, min(value) as value from g group by all),
e as (select label, case when max(vs) > 1 then 'documents disagree' when max(ds) < 2 then 'no shared year' end as error from k group by label)
select series_id, k.period as key, case when e.error is null then k.value end as value, case when k.period is null then 'row not found' else e.error end as error from a left join k on k.label = series_id left join e on e.label = series_id""")
def series_over_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period axis of line items that several documents hold: they state different values, hence no series."""
    asked = values(spark, "series_id string, want_section string, want_label string", [(m, "", m) for m in ("2-HIGH", "5-LOW", "SPACESHIP")])
    return K.period_series(priced(spark, sf_dir).drop("is_total", "value_kind"), asked)


@query(f"""with {PRICED}, a as (select unnest(['2-HIGH', '5-LOW']) as series_id) select series_id, g.period as key, g.value, null::varchar as error from a join g on g.label = series_id and g.doc = 'O'""")
def series_of_one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = values(spark, "series_id string, want_section string, want_label string", [(m, "", m) for m in ("2-HIGH", "5-LOW")])
    return K.period_series(priced(spark, sf_dir).where("doc = 'O'").drop("is_total", "value_kind"), asked)


@query(f"""with {PRICED}, m as (select distinct period || '/' || label as metric_id, label, period from g), t as (select label, period, count(distinct round(value, 4)) as n, min(value) as value from g group by all)
select metric_id, case when n = 1 then 'ok' else 'ambiguous' end as status, case when n = 1 then t.value end as value, 1.0::double as score, least(n_cells, 5)::int as n_candidates
from m join t using (label, period) join (select period, count(*) as n_cells from g group by period) using (period) union all select 'none', 'abstain', null, null, null""")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priority and year as a metric, and one of a year that no table has: each has a row, with its candidates."""
    cells = priced(spark, sf_dir).drop("is_total", "value_kind")
    metrics = cells.select(F.concat_ws("/", "period", "label").alias("metric_id"), F.col("label").alias("want_label"), F.col("period").alias("want_period")).distinct()
    metrics = metrics.unionByName(values(spark, "metric_id string, want_label string, want_period string", [("none", "2-HIGH", "1901")]))
    return K.lookup(cells, metrics).select("metric_id", "status", "value", "score", F.array_size("candidates").alias("n_candidates"))


@query(f"""{SPECS}, s as (select spec_id, count(*) as n, case when count(*) = count(value) then avg(value) end as v from r group by spec_id)
select spec_id, case when v is null then 1 when round(v, 1) <> v then 3 else 2 end::int as n_entries, round(coalesce(v, 0) + 100, 4) as stated from s""")
def compute_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold of 100 and the average as parameters that an answer may state."""
    c = K.combined(resolved_specs(spark, sf_dir), "average")
    p = c.select("spec_id", K.provenance("average", F.array().cast("array<struct<label:string,period:string,raw:string>>"), F.col("value"), 100.0).alias("p"))
    stated = F.aggregate(F.filter("p", lambda e: e["label"] != "result_rounded"), F.lit(0.0), lambda total, e: total + e["value"])
    return p.select("spec_id", F.size("p").alias("n_entries"), F.round(stated, 4).alias("stated"))


@query(f"""with {PRICED}, w as (select *, sum(value) over p - value as others, max(abs(value)) over p as largest, count(value) over p as n from g window p as (partition by doc, period))
select doc, label, period, not coalesce(n >= 2 and not (others <> 0 and abs(value - others) <= 0.02 * abs(others)) and abs(value) < largest and abs(value) < largest * 0.98, false) as ok,
 coalesce(n >= 2 and ((others <> 0 and abs(value - others) <= 0.02 * abs(others)) or abs(value) >= largest or abs(value) < largest * 0.98), false) as decided from w""")
def total_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell used as a total: consistent, a component, or undecided."""
    checked = K.total_consistency(priced(spark, sf_dir).drop("is_total", "value_kind"))
    return checked.select("doc", "label", "period", "ok", "decided")
