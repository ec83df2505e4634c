"""Rules over grids, names, grants and provisions that rows of the tables give; the SQL restates each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import corpus as C
from folioscope.operators import govern as G
from folioscope.operators import ingest, review
from folioscope.operators import tables as T
from folioscope.plans.derived_queries import LINES, lines
from folioscope.plans.ingest_queries import _fy_sql, q, sql_values
from folioscope.plans.registry import ORACLE_SQL, query, read
from folioscope.plans.table_queries import CELLS_SQL

# Grids: an order's line items as the rows of a table.

_GRID = [
    "case when l_linenumber = 1 then '' else concat(' Item ', l_returnflag) end", "case when l_partkey % 2 = 0 then '$' else '—' end", "concat(cast(l_quantity as int), case when l_suppkey % 3 = 0 then '%' else '' end)",
    "case when l_orderkey % 4 = 0 then '—' when l_partkey % 5 = 0 then '' else concat('(', cast(l_linenumber as int), ')') end",
]
_PLACE = "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) as int) - 1"  # line numbers repeat
GRID_SQL = f"raw as (select l_orderkey as table_id, {_PLACE} as r, [{', '.join(_GRID)}] as row from lineitem), cells as (select table_id, r, i::int - 1 as c, trim(row[i]) as text from raw, range(1, 5) as k(i))"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as table_id", f"{_PLACE} as r", f"array({', '.join(_GRID)}) as row")
    return rows.select("table_id", "r", F.posexplode("row").alias("c", "text"))


def over_grid(name: str) -> str:
    """The SQL of a query over fixed cells, over the grids of the line items."""
    return ORACLE_SQL[name].replace(CELLS_SQL, GRID_SQL)


@query(over_grid("table_confidence"))
def grid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.confidence(grid(spark, sf_dir))


@query(over_grid("noise_columns"))
def grid_noise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.without_noise_columns(grid(spark, sf_dir)).select("table_id", "r", "c", T.clean(F.col("text")).alias("text"))


@query(over_grid("merged_currency"))
def grid_merged_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_merged_currency(grid(spark, sf_dir).withColumn("text", T.clean(F.col("text")))).select("table_id", "r", "c", "text")


@query(over_grid("percent_columns"))
def grid_percent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.percent_columns(grid(spark, sf_dir), 0.3)


_WORD = "o_custkey as doc, cast(o_orderkey % 3 as int) as page, case when o_orderkey % 11 = 0 then 'Total' else cast(year(o_orderdate) as varchar(4)) end as text, cast(o_orderkey as double) as x0, o_orderkey % 7 * 2.0 as top"


@query(f"""with w as (select {_WORD} from orders), y as (select doc, page, round(top / 3) as band, text, min(x0) as x0 from w where regexp_matches(text, '^(19|20)\\d{{2}}$') group by all),
b as (select doc, page, band, list(text order by x0) as years from y group by all having count(*) >= 2)
select doc, page, years from (select *, row_number() over (partition by doc, page order by len(years) desc, band) as n from b) where n = 1""")
def order_header_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of orders as words of a customer's pages."""
    return T.header_years(spark.sql(f"select {_WORD.replace('varchar(4)', 'string')} from {{orders}}", orders=read(spark, sf_dir, "orders")))


# Names.

_DAY = "lpad(cast(year(o_orderdate) as varchar(4)), 4, '0')"
_NAME = f"""case o_orderkey % 5 when 0 then concat('acme-', {_DAY}, lpad(cast(month(o_orderdate) as varchar(2)), 2, '0'), lpad(cast(day(o_orderdate) as varchar(2)), 2, '0'), '.pdf') when 1 then concat('acme fy', substr({_DAY}, 3, 2), ' 10k.pdf')
 when 2 then concat('Annual Report ', {_DAY}, '.pdf') when 3 then concat('00009', o_orderkey, '-23-035122.pdf') end"""
_LATEST = f"case when o_orderkey % 3 = 0 then concat('Year Ended December 31, ', {_DAY}) when o_orderkey % 3 = 1 then cast(o_custkey as varchar(20)) end"


@query(f"""select o_orderkey, coalesce({_fy_sql('name')}, list_max(list_transform([latest, '1985'], lambda p: try_cast(nullif(regexp_extract(p, {q(P.NAME_YEAR)}, 2), '') as int)))) as fiscal_year from (select o_orderkey, {_NAME} as name, {_LATEST} as latest from orders)""")
def order_fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files made of an order's date, and two period headers."""
    files = read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_NAME} as name", f"{_LATEST} as latest")
    return files.select("o_orderkey", ingest.fiscal_year(F.col("name"), F.array("latest", F.lit("1985"))).alias("fiscal_year"))


_PLAIN = "' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"""with {LINES}, k as (select md5(label) as label_md5, {_PLAIN} as name from ln) select label_md5, case {' '.join(f"when regexp_matches(name, {q(f' ({hints}) ')}) then {q(kind)}" for kind, hints in review.MATTER_HINTS.items())} end as kind from k""")
def line_matter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as names of files without a known class."""
    return lines(spark, sf_dir).select(F.md5("label").alias("label_md5"), review.matter_kind(F.lit(None).cast("string"), F.col("label")).alias("kind"))


_DASHED = "case when length(label) % 2 = 0 then replace(label, ', ', '.— ') else label end"
_DASH = r"^(.*?)\s*[.]?[—–]\s*(.*)$"


@query(f"""with {LINES}, t as (select md5(label) as label_md5, {_DASHED} as text from ln), d as (select *, regexp_extract(text, {q(_DASH)}, 1) as dash, instr(text, '.') as stop from t)
select label_md5, trim(case when dash <> '' and length(dash) <= 120 then dash when stop between 1 and 120 then left(text, stop - 1) else '' end) as title,
 case when dash <> '' and length(dash) <= 120 then regexp_extract(text, {q(_DASH)}, 2) when stop between 1 and 120 then ltrim(substr(text, stop + 1)) else text end as body from d""")
def line_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles parted from bodies; commas of every other line are made dashes."""
    rows = lines(spark, sf_dir).select(F.md5("label").alias("label_md5"), F.expr(_DASHED).alias("text"))
    title, body = C.title_body(F.col("text"))
    return rows.select("label_md5", title.alias("title"), body.alias("body"))


# Provisions.

_PROVISION = """doc_id, case when doc_id % 11 = 0 then ' ' else source end as source_key, case doc_id % 4 when 0 then 'statute' when 1 then 'novel' when 2 then 'case_law' end as instrument_type,
 case when doc_id % 3 > 0 then lang end as citation, case when doc_id % 5 > 0 then cast(doc_id as varchar(20)) end as section_or_article_id, text, case when doc_id % 7 > 0 then '2020-01-01' end as as_of_date"""


@query(f"""with p as (select {_PROVISION} from documents)
select doc_id, list_filter([case when trim(coalesce(source_key, '')) = '' then 'missing source_key' end, case when coalesce(instrument_type, '') not in {C.INSTRUMENT_TYPES} then 'unknown instrument_type' end, case when trim(coalesce(citation, '')) = '' then 'missing citation' end,
 case when trim(coalesce(section_or_article_id, '')) = '' then 'missing section_or_article_id' end, case when trim(coalesce(text, '')) = '' then 'empty text' end, case when as_of_date is null then 'missing as_of_date' end], lambda x: x is not null) as problems from p""")
def document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as provisions that lack this or that."""
    rows = spark.sql(f"select {_PROVISION.replace('varchar(20)', 'string')} from {{docs}}", docs=read(spark, sf_dir, "documents"))
    return rows.select("doc_id", C.problems(rows).alias("problems"))


_ID = "case when doc_id % 6 > 0 then substr(text, 1 + cast(doc_id % 40 as int), 1 + cast(doc_id % 5 as int)) end"


@query(f"""with d as (select doc_id, text, {_ID} as id from documents) select doc_id, case when coalesce(id, '') <> '' then contains(' ' || regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g') || ' ', ' ' || id || ' ') end as cited from d""")
def documents_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document names a piece of itself as a whole word."""
    return read(spark, sf_dir, "documents").select("doc_id", C.cites(F.col("text"), F.expr(_ID)).alias("cited"))


# Access.

_ROLES = list(P.ROLE_VERBS)
_HELD = "case c_custkey % 10 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_ROLES)) + " else 'stranger' end"
_VERB = "case (c_custkey + {0}) % 17 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(P.ROLE_VERBS[_ROLES[0]])) + " end"
_GRANT = "c_nationkey as user_id, c_custkey as lender_id, case when c_custkey % 3 > 0 then concat('20', 20 + c_custkey % 9, '-01-01') end as expires_at, case when c_custkey % 13 = 0 then '2024-01-01' end as revoked_at"


@query(f"""with g as (select {_GRANT}, {_HELD} as role, unnest([{_VERB.format(0)}, {_VERB.format(5)}]) as verb from customer), h as (select * from {sql_values([(r, v) for r, vs in P.ROLE_VERBS.items() for v in vs], 'role, verb')})
select user_id, list(distinct verb order by verb) as verbs from g join h using (role, verb) where revoked_at is null and (expires_at is null or expires_at > '2024-06-01') group by user_id""")
def customer_delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lend two verbs each to their nation, as far as their own role has them."""
    c = read(spark, sf_dir, "customer")
    grants = spark.sql(f"select {_GRANT}, array({_VERB.format(0)}, {_VERB.format(5)}) as verbs from {{c}}", c=c)
    return G.delegated_verbs(grants, c.selectExpr("c_custkey as user_id", f"{_HELD} as role"), F.lit("2024-06-01"))


_INVITE = "user_id % 20 as firm_id, case when event_id % 2 = 0 then concat(event_type, '@X.org') else concat(upper(event_type), '@x.org') end as email, md5(cast(event_id as varchar(20))) as token_hash, case when value < 5 then ts end as accepted_at, ts as expires_at"


@query(f"""with i as (select {_INVITE} from events) select firm_id, token_hash from (select *, row_number() over (partition by firm_id, lower(email) order by expires_at desc, token_hash) as n from i where accepted_at is null and expires_at > timestamp '2024-01-15 00:00:00') where n = 1""")
def event_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as invites; addresses differ in case."""
    rows = spark.sql(f"select {_INVITE.replace('varchar(20)', 'string')} from {{events}}", events=read(spark, sf_dir, "events"))
    return G.active_invites(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("firm_id", "token_hash")


_BARE = reduce(lambda t, s: f"trim(regexp_replace({t}, '{s}$', ''))", P.PARTY_SUFFIXES, "trim(regexp_replace(regexp_replace(lower(name), '[,.]', ' ', 'g'), '\\s+', ' ', 'g'))")
_KNOWN = "o_orderkey as matter_id, concat('CUSTOMER#', lpad(cast(o_custkey as varchar(20)), 9, '0'), ', Corporation') as name, case o_orderkey % 4 when 0 then 'opposing party' when 1 then 'client' when 2 then 'client, vendor' end as role"
_NEW = "concat(c_name, case when c_custkey % 2 = 0 then ' Corp.' else ' Ltd' end) as name, case when c_custkey % 3 = 0 then 'counterparty' else 'Lender' end as role"


@query(f"""with k as (select *, {_BARE} as key, case when matter_id % 4 = 0 then 'other' when matter_id % 4 = 1 then 'our' else 'neutral' end as known_side from (select {_KNOWN} from orders)),
n as (select name as party, {_BARE} as key, case when role = 'Lender' then 'our' else 'other' end as new_side from (select {_NEW} from customer))
select matter_id, party, name as matched_party, case when (new_side, known_side) in (('our', 'other'), ('other', 'our')) then 'adverse' else 'same_party' end as severity from n join k using (key) where key <> ''""")
def customer_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parties of a new matter, met under another form of their names in orders as matters."""
    known = spark.sql(f"select {_KNOWN.replace('varchar(20)', 'string')} from {{orders}}", orders=read(spark, sf_dir, "orders"))
    new = spark.sql(f"select {_NEW} from {{customer}}", customer=read(spark, sf_dir, "customer"))
    return G.conflicts(new, known).select("matter_id", "party", "matched_party", "severity")


@query("""with d as (select distinct p_partkey::varchar as key from part where p_size % 2 = 0), u as (select distinct l_partkey::varchar as key from lineitem where l_orderkey % 3 = 0)
select key, 'missing' as drift from u where key not in (select key from d) union all select key, 'extra' from d where key not in (select key from u)""")
def part_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of even size as declared, parts of every third order as used."""
    declared = read(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("key"))
    return G.set_drift(declared, read(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_partkey").cast("string").alias("key")))


# Review chains: orders as work on a customer's matter; the customers whose keys follow are its team.

_TITLE = "case ({0}) % 11 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(reversed(_ROLES))) + " else 'temp' end"
_ITEM = "o_orderkey as item_id, o_custkey as matter_id, case when o_orderkey % 13 = 0 then -1 else o_custkey + o_orderkey % 4 end as submitter_id"
_CUSTOM = "case when c_custkey % 8 = 0 then [c_custkey] when c_custkey % 4 = 0 then [c_custkey + 3, c_custkey + 1, c_custkey + 3, c_custkey, c_custkey + 9] end"
_VAULT = "c_custkey as matter_id, case when c_custkey % 3 > 0 then c_custkey + 1 end as owner_id, c_nationkey as firm_id"
_SIZE = "case when c_custkey % 7 = 0 then 0 else 3 end"  # other members
_RANKS = ", ".join(f"('{r}', {i})" for i, r in enumerate(reversed(_ROLES)))
_CHAIN = f"""i as (select distinct {_ITEM} from orders), ranks as (select * from (values {_RANKS}) as t(role, rank)),
tm as (select matter_id, user_id, coalesce(rank, -1) as rank from (select c_custkey as matter_id, c_custkey + j as user_id, {_TITLE.format('c_custkey + j')} as role from customer, range(4) as k(j) where j <= {_SIZE}) left join ranks using (role)),
cu as (select matter_id, user_id, min(place) as place from (select c_custkey as matter_id, unnest({_CUSTOM}) as user_id, generate_subscripts({_CUSTOM}, 1) as place from customer) group by all),
c1 as (select item_id, place, user_id from i join cu using (matter_id) where user_id <> submitter_id),
c2 as (select item_id, tm.rank as place, tm.user_id from i join tm using (matter_id) left join tm o on o.matter_id = i.matter_id and o.user_id = i.submitter_id where tm.rank > coalesce(o.rank, -1) and tm.user_id <> submitter_id and item_id not in (select item_id from c1)),
chain as (select item_id, row_number() over w::int as step, user_id, lead(user_id) over w as next from (select * from c1 union all select * from c2) window w as (partition by item_id order by place, user_id))"""


def review_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    c = read(spark, sf_dir, "customer")
    items = spark.sql(f"select distinct {_ITEM} from {{orders}}", orders=read(spark, sf_dir, "orders"))
    team = c.select(F.col("c_custkey").alias("matter_id"), F.explode(F.expr(f"sequence(c_custkey, c_custkey + {_SIZE})")).alias("user_id"))
    team = team.withColumn("role", F.expr(_TITLE.format("user_id")))
    custom = c.select(F.col("c_custkey").alias("matter_id"), F.posexplode(F.expr(_CUSTOM.replace("[", "array(").replace("]", ")"))).alias("place", "user_id"))
    members = c.selectExpr("c_custkey as user_id", "c_nationkey as firm_id", f"{_TITLE.format('c_custkey')} as role")
    return items, team, spark.sql(f"select {_VAULT} from {{c}}", c=c), members, custom


@query(f"with {_CHAIN} select * from chain")
def matter_review_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, a matter's own order with repeats and strangers, one that names the submitter only, submitters from outside, unknown roles."""
    items, team, _, _, custom = review_tables(spark, sf_dir)
    return G.matter_chain(items, team, custom)


@query(f"""with {_CHAIN}, fm as (select c_nationkey as firm_id, c_custkey as user_id, rank from (select *, {_TITLE.format('c_custkey')} as role from customer) join ranks using (role) where role in {G.RELEASE_TIER}),
v as (select {_VAULT} from customer)
select item_id, coalesce((select arg_min(user_id, step) from chain c where c.item_id = i.item_id), (select arg_max(user_id, rank * 1e12 - user_id) from tm where tm.matter_id = i.matter_id and user_id <> submitter_id),
 case when owner_id <> submitter_id then owner_id end, (select arg_max(user_id, rank * 1e12 - user_id) from fm where fm.firm_id = v.firm_id and user_id <> submitter_id)) as first_owner,
 coalesce((select arg_max(user_id, rank * 1e12 - user_id) from tm where tm.matter_id = i.matter_id and rank >= 6), (select arg_max(user_id, step) from chain c where c.item_id = i.item_id), (select arg_max(user_id, rank * 1e12 - user_id) from tm where tm.matter_id = i.matter_id)) as end_owner
from i left join v using (matter_id)""")
def matter_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who owns an item first and last, with the vault's owner and the firm's partners behind the team."""
    return G.chain_owners(*review_tables(spark, sf_dir))
