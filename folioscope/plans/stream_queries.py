"""Batch twins of the streaming operators, sinks and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import providers
from folioscope.plans.registry import query, read
from folioscope.sources import files
from folioscope.streaming import events as S


def local(df: DataFrame, column: str = "start") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local(S.tumbling_counts(read(spark, sf_dir, "events")))


@query("""with q as (select ts, event_type, floor(epoch(ts))::bigint // 900 * 900 as s from events), w as (select s - 900 * k as s, event_type from q, range(4) as r(k))
select strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from w group by all""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local(S.sliding_counts(read(spark, sf_dir, "events")))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n from s group by user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local(S.session_counts(read(spark, sf_dir, "events")))


@query("select distinct user_id, event_type, strftime(ts, '%Y-%m-%d') as day from events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_dedup(read(spark, sf_dir, "events"))


@query()
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "events").select(F.col("user_id").alias("service"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("value") > 20).alias("ok"))
    return S.breaker(calls, most=3, span=7200, cooldown=3600)


@query("""with c as (select user_id as run_id, event_type as signature, event_id, epoch_us(ts) / 1e6 as sec, value > 10 as ok from events),
p as (select *, sum(case when sec - prior >= 21600 then 1 else 0 end) over (partition by run_id, signature order by sec, event_id) as spell from (select *, lag(sec) over (partition by run_id, signature order by sec, event_id) as prior from c))
select event_id, coalesce(count(*) filter (not ok) over (partition by run_id, signature, spell order by sec, event_id rows between unbounded preceding and 1 preceding), 0) >= 2 as blocked from p""")
def blocked_since_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("signature"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id", (F.col("value") > 10).alias("ok"))
    return S.repeats_blocked(calls, 2, 21600).select("event_id", "blocked")


@query("""select conv_id, string_agg('**' || upper(left(role, 1)) || substr(role, 2) || '**: ' || text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id""")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.conversation_markdown(read(spark, sf_dir, "conversations"))


@query("""with a as (select list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as ws, doc_id from documents)
select doc_id, round(len(list_intersect(['the', 'of', 'apache', 'and'], list_distinct(ws)))::double / 4, 6) as support, len(list_intersect(['the', 'of', 'apache', 'and'], list_distinct(ws)))::double / 4 >= 0.5 as verified from a""")
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic scorer as judge over all documents."""
    return verified(read(spark, sf_dir, "documents"))


@query("""with a as (select list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as ws, doc_id from documents)
select doc_id, round(len(list_intersect(['the', 'of', 'apache', 'and'], list_distinct(ws)))::double / 4, 6) as support, len(list_intersect(['the', 'of', 'apache', 'and'], list_distinct(ws)))::double / 4 >= 0.5 as verified from a""")
def claim_verification_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic scorer as judge over all documents."""
    return verified(read(spark, sf_dir, "documents"))


def verified(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.lit("the of apache and").alias("claim"), F.col("text").alias("evidence"))
    return providers.verify(rows).select("doc_id", F.round("support", 6).alias("support"), "verified")


@query("""with p as (select source as query_id, doc_id as id, row_number() over (partition by source order by doc_id) as rank, count(*) over (partition by source) as n,
 len(list_intersect(['the', 'license', 'of', 'apache'], list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))))::double / 4 as score from documents),
r as (select *, row_number() over (partition by query_id order by case when n > 5 then score end desc nulls last, rank)::int as final_rank from p)
select query_id, id, final_rank, round(score, 6) as score from r where final_rank <= 5""")
def reranked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pool = read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.lit("the license of apache").alias("query"), F.col("doc_id").alias("id"), "text")
    pool = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return providers.rerank(pool, 5).select("query_id", "id", "final_rank", F.round("score", 6).alias("score"))


@query("select event_id, ts > timestamp '2024-01-15 00:00:00' - interval 3600 seconds as fresh from events where event_type = 'click' and ts > timestamp '2024-01-15 00:00:00' - interval 3600 seconds")
def cache_entries_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("namespace"), F.col("ts").alias("cached_at"))
    return files.fresh_entries(cache, "click", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", F.lit(True).alias("fresh"))
