"""Provisions of lines of documents that are given the shape of a statute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import splitters
from folioscope.plans.ingest_queries import q
from folioscope.plans.registry import query, read

_SHAPE = """case when i % 40 = 0 then concat('CHAPTER ', cast(floor(i / 40) as int) + 1)
 when i % 8 = 1 then concat(cast(floor(i / 8) as int) % 9 + 1, '. ', t)
 when i % 8 = 5 then concat(t, ' 1[', cast(floor(i / 8) as int) + 30, '. ', t, case when i % 16 = 5 then ']' else '' end)
 when i % 16 = 3 then concat('1. Subs. by Act ', t)
 when i % 24 = 6 then concat(cast(floor(i / 24) as int) + 60, '. [Repealed.]')
 when i = 90 then 'SECOND SCHEDULE' else t end"""

_I = "(?i)"
_BURIED = r"^(.*?)(?:^|\s)\d{1,3}\[(\d{1,3}[A-Z]{0,2})\.\s+(\S.*)$"
_TITLE = splitters.TITLE.pattern


@query(f"""with raw as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
l as (select doc_id, i, trim(regexp_replace({_SHAPE}, '\\s+', ' ', 'g')) as line, case when doc_id % 2 = 1 then ['1', '2', '3', '5', '8', '30', '32', '60'] end as toc from raw),
m as (select *, regexp_matches(line, {q(_I + splitters.SCHEDULE.pattern)}) as schedule, regexp_matches(line, {q(_I + splitters.CHAPTER.pattern)}) as heads, regexp_matches(line, {q(splitters.OPENER.pattern)}) as plain, regexp_matches(line, {q(_BURIED)}) as buried
 from l where line <> '' and not regexp_matches(line, {q(_I + splitters.FOOTNOTE.pattern)})),
o as (select *, case when heads or schedule then null when plain then regexp_extract(line, {q(splitters.OPENER.pattern)}, 1) when buried then regexp_extract(line, {q(_BURIED)}, 2) end as id from m),
p as (select *, coalesce(id is not null and (toc is null or list_contains(toc, id)), false) as opens from o),
s as (select *, sum(opens::int) over w as sec, last_value(case when heads then upper(regexp_extract(line, {q(_I + splitters.CHAPTER.pattern)}, 1)) || ' ' || upper(regexp_extract(line, {q(_I + splitters.CHAPTER.pattern)}, 2)) end ignore nulls) over w as chapter from p window w as (partition by doc_id order by i)),
k as (select * from (select *, max((schedule and sec > 0)::int) over (partition by doc_id order by i) as ended from s) where ended = 0 and not heads and sec > 0),
r as (select *, case when plain then regexp_extract(line, {q(splitters.OPENER.pattern)}, 2) else regexp_extract(line, {q(_BURIED)}, 3) end as r0, case when plain then '' else trim(regexp_extract(line, {q(_BURIED)}, 1)) end as before from k where opens),
h as (select doc_id, i, sec, id, coalesce(chapter, '') as chapter, before, regexp_extract(rest, {q(_TITLE)}, 1) as title, regexp_extract(rest, {q(_TITLE)}, 3) as body, rest
 from (select *, case when suffix(r0, ']') and not contains(r0, '[') then rtrim(r0, ']') else r0 end as rest from r)),
parts as (select doc_id, sec, i, case when trim(body) = '' then rest else trim(body) end as part from h union all select doc_id, sec - 1, i, before from h union all select doc_id, sec, i, line from k where not opens),
t as (select doc_id, sec, string_agg(part, ' ' order by i) as text from parts where part <> '' group by all),
z as (select *, row_number() over (partition by doc_id, id order by sec) as nth from h)
select doc_id::varchar as source_key, row_number() over (partition by doc_id order by sec)::int as ix, chapter, id as section_id, trim(title, '[] .') as title, md5(coalesce(text, '')) as text_md5,
 regexp_matches(title, {q(_I + splitters.REPEALED.pattern)}) or regexp_matches(body, {q(_I + splitters.REPEALED.pattern)}) as repealed from z left join t using (doc_id, sec) where nth = 1""")
def statutes_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of every document: chapters, sections, buried ones, footnotes, stubs, repeated ids, a schedule, tables of contents."""
    lines = spark.sql(
        f"""select cast(doc_id as string) as source_key, i as elem_ix, {_SHAPE} as text, case when doc_id % 2 = 1 then array('1', '2', '3', '5', '8', '30', '32', '60') end as toc_ids
     from (select doc_id, posexplode(split(text, '\n')) as (i, t) from {{docs}})""",
        docs=read(spark, sf_dir, "documents"),
    )
    found = splitters.statutes(lines)
    return found.select("source_key", "ix", "chapter", "section_id", "title", F.md5("text").alias("text_md5"), "repealed")
