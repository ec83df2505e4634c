"""Versioned corpora, access and governance, analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import analytics as A
from folioscope.operators import corpus as C
from folioscope.operators import govern as G
from folioscope.operators import ingest
from folioscope.plans.ingest_queries import LINES, q, sql_values, values
from folioscope.plans.registry import query, read

# Versioned corpora.


@query(f"""with {LINES}, b as (select doc_id, elem_ix, trim(text) as text, coalesce(lag(trim(text)) over (partition by doc_id order by elem_ix) = '', true) as after_blank from lines),
s as (select *, sum(case when text <> '' and (text like 'The%' or after_blank) then 1 else 0 end) over (partition by doc_id order by elem_ix)::bigint as para_ix from b)
select doc_id, para_ix, md5(string_agg(text, ' ' order by elem_ix)) as text_md5 from s where text <> '' group by doc_id, para_ix""")
def line_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = C.reflowed(ingest.lines(read(spark, sf_dir, "documents")), F.col("text").startswith("The"))
    return paragraphs.select("doc_id", "para_ix", F.md5("text").alias("text_md5"))


STATUTE = [
    ("act", i, t, None)
    for i, t in enumerate([
        "THE EXAMPLE ACT", "CHAPTER I", "PRELIMINARY", "1. Short title.—This Act may be called the Example Act.", "1. Subs. by Act 5 of 2001, for section 1.", "2. Definitions.—In this Act,",
        "court means a civil court. 1[16. Limitation.—No suit lies after three years.]", "CHAPTER II", "17. [Repealed.]", "2. Definitions again.—Twice.", "18A. Costs. The court may award costs", "to either party.", "FIRST SCHEDULE", "19. Not a section",
    ])
]


@query("""select * from (values ('act', 1, 'CHAPTER I', '1', 'Short title', false), ('act', 2, 'CHAPTER I', '2', 'Definitions', false), ('act', 3, 'CHAPTER I', '16', 'Limitation', false), ('act', 4, 'CHAPTER II', '17', 'Repealed', true), ('act', 5, 'CHAPTER II', '18A', 'Costs', false)) as t(source_key, ix, chapter, section_id, title, repealed)""")
def statute_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, a buried number, a repealed stub, a footnote, a repeated id and a schedule that ends the sections."""
    lines = values(spark, "source_key string, elem_ix int, text string, toc_ids array<string>", STATUTE)
    return C.statutes(lines).drop("text")


PROVISIONS = [("k", "statute", "Act 5", "16", "text", "2020-01-01"), (None, "novel", " ", "1", "", None), ("k", "statute", "Act 5", None, "text", "2020-01-01")]


@query("""select * from (values (0, []), (1, ['missing source_key', 'unknown instrument_type', 'missing citation', 'empty text', 'missing as_of_date']), (2, ['missing section_or_article_id'])) as t(id, problems)""")
def provision_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, source_key string, instrument_type string, citation string, section_or_article_id string, text string, as_of_date string", [(i, *r) for i, r in enumerate(PROVISIONS)])
    return rows.select("id", C.problems(rows).alias("problems"))


@query("""with toc as (select p_brand as source_key, p_partkey::varchar as id from part where p_partkey % 5 <> 0), f as (select p_brand as source_key, p_partkey::varchar as id from part where p_partkey % 3 <> 0),
m as (select source_key, count(*) as n_missing, list(id order by id) as missing from toc where (source_key, id) not in (select (source_key, id) from f) group by 1),
t as (select source_key, count(*) as toc_total from toc group by 1), s as (select source_key, count(*) as parsed_total from f group by 1)
select coalesce(t.source_key, s.source_key) as source_key, coalesce(parsed_total, 0)::bigint as parsed_total, coalesce(toc_total, 0)::bigint as toc_total, coalesce(n_missing, 0)::bigint as n_missing, coalesce(missing, []) as missing, round(1 - coalesce(n_missing, 0)::double / toc_total, 6) as coverage
from s full outer join t on s.source_key = t.source_key left join m on m.source_key = t.source_key""")
def toc_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "part").select(F.col("p_brand").alias("source_key"), F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    return C.completeness(ids.where("p_partkey % 5 <> 0").drop("p_partkey"), ids.where("p_partkey % 3 <> 0").drop("p_partkey"))


@query("""with v as (select o_orderkey, o_orderdate::date as enacted, o_orderdate::date + 400 as as_of, o_orderstatus = 'F' and o_orderkey % 4 = 0 as repealed, case when o_orderkey % 7 = 0 then 'x' end as superseded_by from orders)
select o_orderkey, case when date '1996-06-01' < enacted then false when date '1996-06-01' > as_of then null else not repealed and superseded_by is null end as in_force from v""")
def in_force_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("enacted"), F.date_add(F.to_date("o_orderdate"), 400).alias("as_of"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 4 == 0)).alias("repealed"), F.when(F.col("o_orderkey") % 7 == 0, "x").alias("superseded_by"))
    return v.select("o_orderkey", C.in_force(F.lit("1996-06-01").cast("date"), F.col("enacted"), F.col("as_of"), C.is_current(F.col("repealed"), F.col("superseded_by"))).alias("in_force"))


@query("""with v as (select o_custkey % 5 as query_id, o_orderkey, o_orderdate::date as enacted, o_orderdate::date + 400 as as_of from orders),
j as (select *, case when date '1996-06-01' < enacted then false when date '1996-06-01' > as_of then null else true end as f from v)
select query_id, o_orderkey, count(*) filter (f is null) over (partition by query_id) as withheld from j qualify f""")
def asof_filter_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("query_id"), "o_orderkey", F.to_date("o_orderdate").alias("enacted_date"), F.date_add(F.to_date("o_orderdate"), 400).alias("as_of_date"), F.lit(False).alias("repealed"), F.lit(None).cast("string").alias("superseded_by"))
    return C.as_of_filter(rows, F.lit("1996-06-01").cast("date")).select("query_id", "o_orderkey", "withheld")


@query("""with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select user_id, ts, max(event_id) as last_event from events where event_type = 'click' group by all)
select l.event_id, r.last_event from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def asof_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event"))
    return C.latest_before(left, right, "user_id", "ts", "ts", "event_id").select("event_id", F.col("matched.last_event").alias("last_event"))


@query("""select c_custkey, case when c_custkey % 10 = 0 then 0.0 else c_acctbal end as c_acctbal from customer union all select -1, 1.0""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = now.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(values(spark, "c_custkey long, c_acctbal double", [(-1, 1.0)]).withColumn("c_custkey", F.col("c_custkey").cast(now.schema["c_custkey"].dataType)))
    return C.upserted(now, new, ["c_custkey"])


TITLED = [("Short title and extent.—This Act applies.",), ("Costs. The court decides. Always.",), ("x" * 130,)]


@query(f"select * from (values ('Short title and extent.—This Act applies.', 'Short title and extent', 'This Act applies.'), ('Costs. The court decides. Always.', 'Costs', 'The court decides. Always.'), ('{'x' * 130}', '', '{'x' * 130}')) as t(text, title, body)")
def title_body_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, body = C.title_body(F.col("text"))
    return values(spark, "text string", TITLED).select("text", title.alias("title"), body.alias("body"))


# Access.

REQUESTS = [
    (role, verb, target, vault) for role in [*P.ROLE_VERBS, "stranger"] for verb in (*G.VERBS, "fly") for target, vault in ((1, 10), (2, 10), (1, 99))
]


def _grants_sql() -> str:
    return "(" + " or ".join(f"(role = {q(r)} and verb in ({', '.join(map(q, v))}))" for r, v in P.ROLE_VERBS.items() if v) + ")"


@query(f"""select role, verb, target_firm, vault_id, case when verb not in ({', '.join(map(q, G.VERBS))}) then 'unknown verb' when target_firm <> 1 then 'cross-firm' when vault_id = 99 then 'screened' when verb = 'draft' then 'delegation'
 when {_grants_sql()} then 'role' when role in ('client', 'guest') then 'external' else 'not granted' end as reason from {sql_values(REQUESTS, 'role, verb, target_firm, vault_id')}""")
def authorize_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "role string, verb string, target_firm int, vault_id int", REQUESTS)
    facts = rows.withColumns({"firm_id": F.lit(1), "screened": F.array(F.lit(99)), "delegated": F.array(F.lit("draft"))})
    return G.authorised(facts).select("role", "verb", "target_firm", "vault_id", "reason")


def _vault_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Customers as vaults and as members, nations as firms."""
    c = read(spark, sf_dir, "customer")
    vaults = c.select(F.col("c_custkey").alias("vault_id"), F.col("c_nationkey").alias("firm_id"), (F.col("c_custkey") % 100 + 1).alias("owner_id"))
    members = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("firm_id"), F.when(F.col("c_custkey") % 20 == 0, "partner").otherwise("associate").alias("role"))
    staffed = c.where("c_custkey % 9 = 0").select((F.col("c_custkey") % 50 + 1).alias("user_id"), F.col("c_custkey").alias("vault_id"))
    screens = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") % 100 + 1).alias("user_id"), F.col("c_custkey").alias("vault_id"), F.when(F.col("c_custkey") % 8 == 0, F.lit("2024-01-01")).alias("removed_at"))
    return vaults, members, staffed, screens


VAULTS = """vaults as (select c_custkey as vault_id, c_nationkey as firm_id, c_custkey % 100 + 1 as owner_id from customer),
members as (select c_custkey as user_id, c_nationkey as firm_id, case when c_custkey % 20 = 0 then 'partner' else 'associate' end as role from customer),
staffed as (select c_custkey % 50 + 1 as user_id, c_custkey as vault_id from customer where c_custkey % 9 = 0),
walls as (select c_custkey % 100 + 1 as user_id, c_custkey as vault_id from customer where c_custkey % 4 = 0 and c_custkey % 8 <> 0)"""


@query(f"""with {VAULTS}, s as (select user_id, vault_id from vaults join members using (firm_id) where role = 'partner' union select owner_id, vault_id from vaults where owner_id in (select user_id from members)
  union select s.user_id, s.vault_id from staffed s join members m on m.user_id = s.user_id join vaults v on v.vault_id = s.vault_id and v.firm_id = m.firm_id)
select user_id, vault_id from s where (user_id, vault_id) not in (select (user_id, vault_id) from walls)""")
def visible_minus_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visible(*_vault_tables(spark, sf_dir)).select("user_id", "vault_id")


@query(f"""with {VAULTS}, r as (select user_id, vault_id from staffed union select owner_id, vault_id from vaults union select user_id, vault_id from walls)
select r.user_id, r.vault_id, case when owner_id = r.user_id then r.user_id when v.firm_id = m.firm_id and (r.user_id, r.vault_id) in (select (user_id, vault_id) from staffed) and (r.user_id, r.vault_id) not in (select (user_id, vault_id) from walls) then owner_id end as owner
from r left join vaults v using (vault_id) left join members m on m.user_id = r.user_id""")
def vault_owner_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    vaults, members, staffed, screens = _vault_tables(spark, sf_dir)
    pairs = (staffed, vaults.select(F.col("owner_id").alias("user_id"), "vault_id"), screens.where("removed_at is null"))
    asked = reduce(DataFrame.unionByName, (p.select("user_id", "vault_id") for p in pairs)).distinct()  # all who have to do with a vault
    return G.vault_owner(asked, vaults, members, staffed, screens)


GRANTS = [
    (1, 10, ["draft", "delete", "ask"], None, None), (1, 11, ["sign_certificate", "ask"], "2030-01-01", None), (2, 10, ["draft"], "2020-01-01", None),
    (3, 10, ["draft"], None, "2024-01-01"), (4, 12, ["ask", "draft"], None, None),
]
LENDERS = [(10, "senior_associate"), (11, "partner"), (12, "client")]


@query("select * from (values (1, ['ask', 'delete', 'draft', 'sign_certificate']), (4, ['ask'])) as t(user_id, verbs)")
def delegated_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = values(spark, "user_id int, lender_id int, verbs array<string>, expires_at string, revoked_at string", GRANTS)
    return G.delegated_verbs(grants, values(spark, "user_id int, role string", LENDERS), F.lit("2024-06-01"))


NEW_PARTIES = [("Acme Corp.", "client"), ("Globex Ltd", "counterparty"), ("Initech", None), ("", "client"), ("Solo GmbH", "client, vendor")]
KNOWN_PARTIES = [(1, "ACME corporation", "opposing party"), (1, "Other", "client"), (2, "GLOBEX, Limited", "client"), (3, "initech", "client"), (4, "Solo", "vendor")]


@query("""select * from (values ('Acme Corp.', 1, 'ACME corporation', 'our', 'other', 'adverse'), ('Globex Ltd', 2, 'GLOBEX, Limited', 'other', 'our', 'adverse'), ('Initech', 3, 'initech', 'neutral', 'our', 'same_party'), ('Solo GmbH', 4, 'Solo', 'neutral', 'other', 'same_party')) as t(party, matter_id, matched_party, new_side, known_side, severity)""")
def conflict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conflicts(values(spark, "name string, role string", NEW_PARTIES), values(spark, "matter_id int, name string, role string", KNOWN_PARTIES))


MEMBERS = [(1, 1, "associate"), (2, 1, "partner"), (3, 1, "managing_partner"), (4, 1, "senior_associate"), (5, 2, "partner"), (6, 1, "paralegal")]


@query("select * from (values (7, 1, 4, 2), (7, 2, 2, 3), (7, 3, 3, null)) as t(item_id, step, user_id, next)")
def review_chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.review_chain(values(spark, "item_id int, submitter_id int", [(7, 1)]), values(spark, "user_id int, firm_id int, role string", MEMBERS))


@query("""select user_id, count(*) as rows, case when user_id % 10 = 0 and count(*) >= 3 then 3 end as first_break, not (user_id % 10 = 0 and count(*) >= 3) as valid from events group by user_id""")
def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a signed chain; every tenth user's third row was edited after signing."""
    columns = ["event_id", "event_type"]
    chain = G.signed(read(spark, sf_dir, "events").select("user_id", *columns), "user_id", "event_id", columns)
    edited = chain.withColumn("event_type", F.when((F.col("user_id") % 10 == 0) & (F.col("seq") == 3), "edited").otherwise(F.col("event_type")))
    return G.verified_chain(edited, "user_id", columns)


@query("""select user_id, event_type, strftime(ts, '%Y-%m-%d') as day, sha256(user_id || '|' || event_type || '||' || strftime(ts, '%Y-%m-%d')) as dedup_key, min(event_id) as event_id from events group by all""")
def notification_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    keyed = read(spark, sf_dir, "events").withColumn("day", day).withColumn("dedup_key", G.dedup_key(F.col("user_id").cast("string"), F.col("event_type"), F.lit(""), day))
    return keyed.groupBy("user_id", "event_type", "day", "dedup_key").agg(F.min("event_id").alias("event_id"))


@query("""select event_id, case when hour(ts) >= 21 or hour(ts) < 7 then true else false end as quiet, hour(ts) >= 9 and hour(ts) < 12 as quiet_day from events""")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return read(spark, sf_dir, "events").select("event_id", G.in_quiet_hours(hour, F.lit(21), F.lit(7)).alias("quiet"), G.in_quiet_hours(hour, F.lit(9), F.lit(12)).alias("quiet_day"))


@query("""with ev as (select event_id, case event_type when 'click' then 'review.awaiting' when 'view' then 'matter.staffed' when 'purchase' then 'answer.overridden' else 'other' end as event, user_id as actor_id, (user_id * 7) % 150 as recipient_id, user_id % 3 as firm_id, event_id % 20 as vault_id, ts as sent_at from events),
k as (select *, case event when 'review.awaiting' then 'review' when 'matter.staffed' then 'matter' when 'answer.overridden' then 'governance' else 'review' end as category from ev
 where recipient_id <> actor_id and recipient_id % 3 = firm_id and not (recipient_id % 20 = vault_id) and not (recipient_id % 5 = 0 and (case event when 'matter.staffed' then 'matter' else '' end) = 'matter')),
d as (select *, sha256(recipient_id || '|' || event || '|' || vault_id || '|' || strftime(k.sent_at, '%Y-%m-%d')) as dedup_key from k)
select event_id, recipient_id, category, dedup_key from (select *, row_number() over (partition by dedup_key order by sent_at, event_id) as n from d) where n = 1""")
def notification_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "review.awaiting").when(F.col("event_type") == "view", "matter.staffed").when(F.col("event_type") == "purchase", "answer.overridden").otherwise("other")
    ev = read(spark, sf_dir, "events").select("event_id", kind.alias("event"), F.col("user_id").alias("actor_id"), ((F.col("user_id") * 7) % 150).alias("recipient_id"), (F.col("user_id") % 3).alias("firm_id"), (F.col("event_id") % 20).alias("vault_id"), (F.col("event_id") % 20).alias("resource_id"), F.col("ts").alias("at"))
    users = spark.range(150).withColumnRenamed("id", "user_id")
    members = users.select("user_id", (F.col("user_id") % 3).alias("firm_id"))
    screens = users.select("user_id", (F.col("user_id") % 20).alias("vault_id"), F.lit(None).cast("string").alias("removed_at"))
    prefs = users.where("user_id % 5 = 0").select("user_id", F.array(F.lit("matter")).alias("muted"))
    return G.notifications(ev, members, screens, prefs)


@query("""select conv_id, turn, role, case when conv_id % 4 = 0 and role = 'user' then '[erased]' else text end as text from conversations""")
def erasure_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.erased(read(spark, sf_dir, "conversations"), F.col("conv_id") % 4 == 0, ["text"], F.col("role") != "user").select("conv_id", "turn", "role", "text")


@query("""select event_id, case when event_type = 'click' and ts < timestamp '2024-01-15 12:00:00' - interval 15 minutes then 'failed' when event_type = 'click' then 'processing' else 'ready' end as status from events""")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "processing").otherwise("ready").alias("status"), F.col("ts").alias("updated_at"))
    return G.swept(docs, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id", "status")


DECLARED, USED = [("a",), ("b",), ("c",)], [("b",), ("d",), ("d",)]


@query("select * from (values ('d', 'missing'), ('a', 'extra'), ('c', 'extra')) as t(key, drift)")
def set_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.set_drift(values(spark, "key string", DECLARED), values(spark, "key string", USED))


# Analytics.

LOG = "log as (select ts as sent, case when value > 5 then value end as latency_ms, event_type = 'click' as cache_hit, event_type = 'view' as agentic, event_type = 'purchase' as web from events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    flag = lambda t: F.col("event_type") == t
    return e.select(F.col("ts").alias("at"), F.when(F.col("value") > 5, F.col("value")).alias("latency_ms"), flag("click").alias("cache_hit"), flag("view").alias("agentic"), flag("purchase").alias("web"))


@query(f"""with {LOG} select count(*) as queries, round(avg(latency_ms), 1) as avg_latency, round(avg(cache_hit::int) * 100, 1) as cache_rate, round(avg(agentic::int) * 100, 1) as agentic_rate, round(avg(web::int) * 100, 1) as web_rate,
 count(*) filter (sent::date = date '2024-01-28') as today, count(*) filter (sent::date >= date '2024-01-21') as last_7_days from log where sent >= timestamp '2024-01-28 12:00:00' - interval 14 days""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_summary(log(spark, sf_dir), F.lit("2024-01-28 12:00:00").cast("timestamp_ntz"), 14)


@query("select ts::date as day, count(*) as n from events group by 1")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_counts(log(spark, sf_dir))


@query("""select left(text, 50) as query, count(*) as n, max(conv_id * 100 + turn) as last_at from conversations group by 1 order by n desc, last_at desc, query limit 5""")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_queries(read(spark, sf_dir, "conversations").select(F.col("text").alias("query"), (F.col("conv_id") * 100 + F.col("turn")).alias("at")))


@query("""select event_id, event_type, (select count(*) from events where event_type in ('click', 'view')) as total from events where event_type in ('click', 'view') order by ts desc, event_id desc limit 20 offset 40""")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    return A.page(kept, 3, 20, [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type", "total")


@query("select distinct event_type as action from events")
def distinct_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("action")).distinct()


@query('select \'documents\' as "table", count(*) as n from documents union all select \'events\', count(*) from events union all select \'pages\', count(*) from pages')
def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table_counts({t: read(spark, sf_dir, t) for t in ("documents", "events", "pages")})


@query("select n_nationkey, count(s_suppkey) as n from nation left join supplier on s_nationkey = n_nationkey group by 1")
def documents_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts_with_zero(read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")


@query("select event_type, user_id % 5 as team, grouping(event_type, user_id % 5)::bigint as level, count(*) as n from events group by cube (event_type, user_id % 5)")
def usage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_cube(read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("team")), ["event_type", "team"])


@query("""with c as (select user_id as service, event_id, epoch(date_trunc('second', ts))::bigint as s, value > 20 as ok from events),
w as (select *, count(*) filter (not ok) over (partition by service order by s range between 3599 preceding and current row) as recent_failures from c)
select service, event_id, recent_failures, not ok and recent_failures >= 2 as trips from w""")
def breaker_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").select(F.col("user_id").alias("service"), "event_id", F.col("ts").alias("at"), (F.col("value") > 20).alias("ok"))
    return A.breaker_windows(c, 2, 3600).select("service", "event_id", "recent_failures", "trips")


@query("select conv_id, left(arg_min(text, turn), 60) as title from conversations where role = 'user' group by conv_id")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_messages(read(spark, sf_dir, "conversations"))


@query("select case when value < 0 then 0 when value >= 100 then 11 else floor(value / 10)::bigint + 1 end as bucket, count(*) as n from events group by 1")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(read(spark, sf_dir, "events"), "value", 0.0, 100.0, 10)


INVITES = [(1, "A@x.org", "h1", None, "2025-01-01"), (1, "a@X.org", "h2", None, "2025-02-01"), (1, "b@x.org", "h3", "2024-01-01", "2025-01-01"), (2, "a@x.org", "h4", None, "2023-01-01")]


@query("select 1 as firm_id, 'h2' as token_hash")
def active_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "firm_id int, email string, token_hash string, accepted_at string, expires_at string", INVITES)
    return G.active_invites(rows, F.lit("2024-06-01")).select("firm_id", "token_hash")


@query("select user_id, count(*) filter (value < 10) as unread from events group by user_id")
def unread_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notifications, read where their value is 10 or more."""
    e = read(spark, sf_dir, "events")
    return G.unread(e.select("user_id", F.when(F.coalesce(F.col("value") >= 10, F.lit(True)), F.col("ts")).alias("read_at")))
