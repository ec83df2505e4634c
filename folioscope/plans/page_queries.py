"""Tables read from the words of pages, which are made of orders: a page holds 64, a line each, with a price and a number in
parentheses at the right.

Every eighth line has one more number, clearly left of the columns; the next has it close to them, where it stands under none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import tables as T
from folioscope.plans.registry import query, read

_ORDERS = """o as (select o_orderkey // 64 as page, o_orderkey % 8 as r, 'Order K' || o_orderkey as name, format('{:,}', floor(o_totalprice)::bigint) as p, '(' || (o_custkey + 3000) || ')' as c, floor(o_totalprice) as pv, -(o_custkey + 3000)::double as cv from orders),
t as (select *, name || case r when 6 then ' 7,519' when 7 then ' 7,519 ' || p || ' ' || c else '' end as label from o)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, number = F.format_number(F.floor("o_totalprice"), 0), F.concat(F.lit("("), (F.col("o_custkey") + 3000).cast("string"), F.lit(")"))
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.lit("d").alias("doc"), F.floor(key / 64).alias("page"), (key % 64).alias("line"), (key % 8).alias("r"), F.concat(F.lit("K"), key).alias("name"), price.alias("p"), number.alias("c"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their places; even pages have a band of two years."""
    o = orders(spark, sf_dir)
    word = lambda text, x0, x1: F.struct(text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    plain = [word(F.lit("Order"), 30, 60), word(F.col("name"), 62, 90), word(F.col("p"), 206, 220), word(F.col("c"), 280, 300)]
    extra = F.when(F.col("r") == 6, F.array(*plain, word(F.lit("7,519"), 130, 150))).when(F.col("r") == 7, F.array(*plain, word(F.lit("7,519"), 180, 204))).otherwise(F.array(*plain))
    lines = o.select("doc", "page", F.explode(extra).alias("w"), (12.0 * (F.col("line") + 2)).alias("top")).select("doc", "page", "w.*", "top")
    years = o.where("page % 2 = 0").select("doc", "page").distinct().select("doc", "page", F.explode(F.array(word(F.lit("2022"), 200, 220), word(F.lit("2023"), 280, 300))).alias("w")).select("doc", "page", "w.*", F.lit(0.0).alias("top"))
    return lines.unionByName(years)


@query(f"""with {_ORDERS} select page, label, case when r = 7 then '' else p || '|' || c end as cells, case when r >= 6 then 'over' else 'row' end as kind from t""")
def anchored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a number too many: its place tells whether the others stand under the columns."""
    rows = T.span_rows(T.span_numbers(T.lines_from_words(words(spark, sf_dir))))
    return rows.select("page", "label", F.array_join("values", "|").alias("cells"), "kind")


@query(f"""with {_ORDERS}, g as (select page, 'geometry' as found_by, label, p, c, pv, cv, page % 2 = 0 as dated from t where page % 5 <> 0 and r <> 7 union all select page, 'grid', name, p, c, pv, cv, false from t where page % 10 = 0)
select page, found_by, label, 1::int as slot, case when dated then '2022' else 'col_1' end as period, dated as is_period, p as raw, pv as value from g union all select page, found_by, label, 2, case when dated then '2023' else 'col_2' end, dated, c, cv from g""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page has no words; tables found otherwise, on every page whose number ends with 0 or 1, stand in where there are none."""
    o = orders(spark, sf_dir).where("page % 10 <= 1")
    name = F.concat(F.lit("Order "), "name")
    grids = o.select("doc", "page", F.concat(F.lit("g"), "page").alias("table_id"), F.col("line").alias("r"), F.posexplode(F.array(name, "p", "c")).alias("c_", "text")).withColumnRenamed("c_", "c")
    found = T.document_tables(words(spark, sf_dir).where("page % 5 <> 0"), grids)
    return found.select("page", "found_by", "label", "slot", "period", "is_period", "raw", "value")
