"""Access, conflicts, review chains, notifications, signatures, data rights."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import patterns as P

VERBS = tuple(dict.fromkeys(v for verbs in P.ROLE_VERBS.values() for v in verbs))


def role_grants(role: Column, verb: Column) -> Column:
    return F.coalesce(reduce(lambda c, r: c.when(role == r, verb.isin(*P.ROLE_VERBS[r]) if P.ROLE_VERBS[r] else F.lit(False)), P.ROLE_VERBS, F), F.lit(False))


def authorised(requests: DataFrame) -> DataFrame:
    """``allow`` and ``reason`` in fixed order: unknown verb, other firm, screen, delegation, role, else no.

    requests: firm_id, role, verb, target_firm, vault_id, screened (array), delegated (array).
    """
    verb = F.col("verb")
    other_firm = F.col("target_firm").isNotNull() & (F.col("target_firm") != F.col("firm_id"))
    walled = F.col("vault_id").isNotNull() & F.coalesce(F.array_contains("screened", F.col("vault_id")), F.lit(False))
    lent = F.coalesce(F.array_contains("delegated", verb), F.lit(False))
    reason = (
        F.when(~F.coalesce(verb.isin(*VERBS), F.lit(False)), "unknown verb").when(other_firm, "cross-firm").when(walled, "screened")
        .when(lent, "delegation").when(role_grants(F.col("role"), verb), "role").when(F.col("role").isin("client", "guest"), "external").otherwise("not granted")
    )
    return requests.withColumn("reason", reason).withColumn("allow", F.col("reason").isin("delegation", "role"))


#: Ids of a block of the left and of the right side, and of the pieces that a block is gone through in.
LEFT_BLOCK, RIGHT_BLOCK, LEFT_PIECE, RIGHT_PIECE = 4096, 1024, 256, 64


def _blocks(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Rows (group, key, key_screened) as arrays ``key``s of about ``most`` keys of one group that are all screened or all not."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / most).alias("__n"))
    dealt = rows.join(sizes, group).withColumn(f"{key}_block", F.pmod(F.xxhash64(key), F.col("__n")))
    kept = F.transform(F.array_sort(F.collect_list(F.struct(key))), lambda x: x[key])  # in a struct, a null stays
    return dealt.groupBy(group, f"{key}_screened", f"{key}_block").agg(kept.alias(f"{key}s"))


def _pieces(ids: str, most: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(most)), lambda i: F.slice(ids, i, F.lit(most)))


def crossed(left: DataFrame, right: DataFrame, group: str, a: str, b: str, wanted: Column, parts: int) -> DataFrame:
    """(a, b): every a of ``left`` with every b of ``right`` of the same group, where ``wanted`` holds of a_screened and b_screened.

    Only pairs of blocks are shuffled, about a hundredth of a byte for a row, and each makes some four million rows at most.  The
    ``parts`` tasks get like numbers of pairs whatever the groups' sizes; blocks of few screened keys make theirs smaller.  Rows come in the order that columnar files store best: 256 values of
    ``a`` again and again, each time beside one ``b``, and few different ids in a task, so that dictionaries hold them.
    """
    met = _blocks(left, group, a, LEFT_BLOCK).join(_blocks(right, group, b, RIGHT_BLOCK), group).where(wanted)
    dealt = met.repartitionByRange(parts, group, f"{a}_screened", f"{a}_block", f"{b}_screened", f"{b}_block")
    pieces = dealt.select(F.explode(_pieces(f"{a}s", LEFT_PIECE)).alias(a), f"{b}s").select(a, F.explode(_pieces(f"{b}s", RIGHT_PIECE)).alias(b))
    # moves nothing, but parts the generated loops: one loop over a whole block would hold all its rows before it passed on the first
    return pieces.coalesce(parts).select(a, F.explode(b).alias(b)).select(F.explode(a).alias(a), b)


def visible(vaults: DataFrame, members: DataFrame, staffed: DataFrame, screens: DataFrame) -> DataFrame:
    """(user_id, vault_id) that each member sees: partners their firm's, others what they own or are staffed on within their firm; screens take away.

    vaults: vault_id, firm_id, owner_id; members: user_id, firm_id, role; staffed: user_id, vault_id; screens: user_id,
    vault_id, removed_at.

    What partners see is as many rows as firms have partners times vaults.  It is neither sorted nor shuffled row by row: pairs of a
    vault with one firm are distinct as they are and come from blocks (``crossed``), and screens are asked only where both user and vault
    have one.
    """
    n_vaults = vaults.count()
    here = Window.partitionBy("vault_id")
    mixed = (F.min("firm_id").over(here) != F.max("firm_id").over(here)) | (F.count("firm_id").over(here) < F.count("*").over(here))
    vaults = vaults.select("vault_id", "firm_id", "owner_id").withColumn("mixed", F.coalesce(mixed, F.lit(False)))
    partners = members.where(F.col("role").isin("managing_partner", "senior_partner", "partner")).select("user_id", "firm_id").distinct()
    active = screens.where("removed_at is null").select("user_id", "vault_id").distinct()
    screened = lambda key: active.select(key).distinct().withColumn(f"{key}_screened", F.lit(True))

    of_one = vaults.where(~F.col("mixed")).select("vault_id", "firm_id").distinct().join(screened("vault_id"), "vault_id", "left")
    leads = partners.join(screened("user_id"), "user_id", "left")
    parts = max(4 * vaults.sparkSession.sparkContext.defaultParallelism, -(-max(n_vaults, members.count()) // (8 * LEFT_BLOCK)))
    both = F.coalesce(F.col("vault_id_screened") & F.col("user_id_screened"), F.lit(False))
    free = crossed(of_one, leads, "firm_id", "vault_id", "user_id", ~both, parts)
    asked = of_one.where("vault_id_screened").repartition(parts, "vault_id").join(leads.where("user_id_screened"), "firm_id").select("user_id", "vault_id")
    of_many = vaults.where("mixed").join(partners, "firm_id").select("user_id", "vault_id")

    owned = vaults.select(F.col("owner_id").alias("user_id"), "vault_id", "firm_id", "mixed").join(members.select("user_id"), "user_id", "left_semi")
    of_member = staffed.select("user_id", "vault_id").join(members.select("user_id", "firm_id"), "user_id")
    own_firm = of_member.join(vaults.select("vault_id", "firm_id", "mixed"), ["vault_id", "firm_id"])
    own = owned.unionByName(own_firm)
    others = own.where(~F.col("mixed")).join(partners, ["user_id", "firm_id"], "left_anti").unionByName(own.where("mixed")).select("user_id", "vault_id")
    return free.select("user_id", "vault_id").unionByName(asked.unionByName(of_many).unionByName(others).distinct().join(active, ["user_id", "vault_id"], "left_anti"))


def policy_view(rows: DataFrame, grants: DataFrame, user) -> DataFrame:
    """The rows of one principal: those of vaults granted; nothing without grants."""
    return rows.join(grants.where(F.col("user_id") == F.lit(user)).select("vault_id"), "vault_id", "left_semi")


def delegated_verbs(grants: DataFrame, roles: DataFrame, now: Column) -> DataFrame:
    """(user_id, verbs): the union of what active grants lend, as far as the lender's role has it."""
    active = grants.where("revoked_at is null").where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    lent = active.join(roles.select(F.col("user_id").alias("lender_id"), "role"), "lender_id").select("user_id", "role", F.explode("verbs").alias("verb"))
    return lent.where(role_grants(F.col("role"), F.col("verb"))).groupBy("user_id").agg(F.array_sort(F.collect_set("verb")).alias("verbs"))


def normal_party(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[,.]", " "), r"\s+", " "))
    for suffix in P.PARTY_SUFFIXES:
        bare = F.trim(F.regexp_replace(bare, suffix + "$", ""))  # refers to ``bare`` once, so the expression stays small
    return bare


def side(role: Column) -> Column:
    words = F.split(F.lower(F.coalesce(role, F.lit(""))), "[^a-z0-9]+")
    ours, others = F.arrays_overlap(words, F.array(*map(F.lit, P.OUR_SIDE))), F.arrays_overlap(words, F.array(*map(F.lit, P.OTHER_SIDE)))
    return F.when(ours & ~others, "our").when(others & ~ours, "other").otherwise("neutral")


def conflicts(new: DataFrame, known: DataFrame) -> DataFrame:
    """Parties (name, role) of a new matter met in other matters (matter_id, name, role): adverse where the sides are opposite."""
    a = new.select(F.col("name").alias("party"), normal_party(F.col("name")).alias("key"), side(F.col("role")).alias("new_side")).where("key <> ''")
    b = known.select("matter_id", F.col("name").alias("matched_party"), normal_party(F.col("name")).alias("key"), side(F.col("role")).alias("known_side"))
    opposite = F.array_sort(F.array("new_side", "known_side")) == F.array(F.lit("other"), F.lit("our"))
    return a.join(b, "key").withColumn("severity", F.when(opposite, "adverse").otherwise("same_party")).drop("key")


ROLE_RANK = {r: i for i, r in enumerate(reversed(list(P.ROLE_VERBS)))}


def review_chain(items: DataFrame, members: DataFrame) -> DataFrame:
    """(item_id, step, user_id): the members of the submitter's firm above its rank, nearest first; ``next`` is who follows."""
    rank = lambda c: reduce(lambda w, r: w.when(c == r, ROLE_RANK[r]), ROLE_RANK, F)
    m = members.withColumn("rank", rank(F.col("role")))
    submitter = m.select(F.col("user_id").alias("submitter_id"), "firm_id", F.col("rank").alias("own"))
    above = items.join(submitter, "submitter_id").join(m.select("firm_id", "user_id", "rank"), "firm_id").where("rank > own")
    order = Window.partitionBy("item_id").orderBy("rank", "user_id")
    return above.select("item_id", F.row_number().over(order).alias("step"), "user_id", F.lead("user_id").over(order).alias("next"))


RELEASE_TIER = ("managing_partner", "senior_partner", "partner")  # fixed value: who may release work outside


def seniority(role: Column) -> Column:
    """The higher the more senior; unknown roles and null are below all."""
    return F.coalesce(reduce(lambda w, r: w.when(role == r, ROLE_RANK[r]), ROLE_RANK, F), F.lit(-1))


def _teams(team: DataFrame) -> DataFrame:
    """A member of a matter once, with its most senior role."""
    return team.groupBy("matter_id", "user_id").agg(F.max(seniority(F.col("role"))).alias("rank"))


def _most_senior(people: DataFrame, key: str, name: str) -> DataFrame:
    """The two most senior (user_id, rank) of each key as an array: whoever asks, one of them is somebody else."""
    place = Window.partitionBy(key).orderBy(F.desc("rank"), "user_id")
    two = people.withColumn("__n", F.row_number().over(place)).where("__n <= 2")
    return two.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "user_id"))), lambda x: x["user_id"]).alias(name))


def matter_chain(items: DataFrame, team: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(item_id, step, user_id, next): who reviews an item (item_id, matter_id, submitter_id) in turn, and who follows.

    A matter's own order (``custom``: matter_id, place, user_id) is kept as it stands, without the submitter and without repeats.
    Where it names nobody else, those of the matter's team (matter_id, user_id, role) above the submitter's rank review,
    the nearest first, equal ranks by user_id; a submitter from outside the team is below all.
    """
    people = team.select("matter_id", "user_id", seniority(F.col("role")).alias("rank"), F.lit(None).cast("int").alias("place"), F.lit(False).alias("named"))
    if custom is not None:
        given = custom.where("user_id is not null").select("matter_id", "user_id", F.lit(None).cast("int").alias("rank"), F.col("place").cast("int").alias("place"), F.lit(True).alias("named"))
        people = people.unionByName(given)
    # dealt out first: next to nothing would come together in the part of the table that a task reads
    people = people.repartition("matter_id").groupBy("matter_id", "user_id").agg(F.max("rank").alias("rank"), F.min("place").alias("place"), F.max("named").alias("named"))
    people = people.withColumn("n_named", F.count_if("named").over(Window.partitionBy("matter_id")))
    submitter = people.select("matter_id", F.col("user_id").alias("submitter_id"), F.col("rank").alias("own"), F.col("named").alias("own_named"))
    # teams grow with the matters, and a task would hold all of them at once if they were sent to every one
    asked = items.select("item_id", "matter_id", "submitter_id").join(submitter.hint("merge"), ["matter_id", "submitter_id"], "left")
    met = asked.join(people.hint("merge"), "matter_id").where("user_id <> submitter_id")
    others = F.col("n_named") > F.coalesce(F.col("own_named"), F.lit(False)).cast("int")
    steps = met.withColumn("by_rank", ~others).where(F.when(others, F.col("named")).otherwise(F.col("rank") > F.coalesce("own", F.lit(-1))))
    steps = steps.select("item_id", "by_rank", F.when(F.col("by_rank"), F.col("rank")).otherwise(F.col("place")).alias("place"), "user_id")
    # an item under several matters keeps to an order of their own where one of them has it
    order = Window.partitionBy("item_id").orderBy("by_rank", "place", "user_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.when(F.lead("by_rank").over(order) == F.col("by_rank"), F.lead("user_id").over(order))
    numbered = steps.select("item_id", F.row_number().over(order).alias("step"), "user_id", follows.alias("next"), "by_rank", F.first("by_rank").over(so_far).alias("__first"))
    return numbered.where(F.col("by_rank") == F.col("__first")).select("item_id", "step", "user_id", "next")


def chain_owners(items: DataFrame, team: DataFrame, vaults: DataFrame, members: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(item_id, first_owner, end_owner) of each item, one row for each.

    First owner: the first of the chain, else the matter's most senior other member, else the vault's owner (vaults: matter_id,
    owner_id, firm_id), else the most senior other member of the firm (members: user_id, firm_id, role) who may release; never the
    submitter, null if there is nobody.  End owner: the matter's most senior member who may release, else the last of the chain,
    else the matter's most senior member.
    """
    chain = matter_chain(items, team, custom).groupBy("item_id").agg(F.min_by("user_id", "step").alias("first"), F.max_by("user_id", "step").alias("last"))
    ranked = _teams(team)
    releasing = F.col("rank") >= min(ROLE_RANK[r] for r in RELEASE_TIER)
    tops = _most_senior(ranked, "matter_id", "tops")
    closers = _most_senior(ranked.where(releasing), "matter_id", "closers")
    firm = members.select("firm_id", "user_id", seniority(F.col("role")).alias("rank")).where(releasing).groupBy("firm_id", "user_id").agg(F.max("rank").alias("rank"))
    of = items.select("item_id", "matter_id", "submitter_id").join(chain.hint("merge"), "item_id", "left")
    for matters in (tops, closers, vaults.select("matter_id", "owner_id", "firm_id")):  # they grow with the matters too
        of = of.join(matters.hint("merge"), "matter_id", "left")
    of = of.join(_most_senior(firm, "firm_id", "backstop"), "firm_id", "left")
    other = lambda c: F.get(F.filter(c, lambda u: u != F.col("submitter_id")), F.lit(0))
    owner = F.when(F.col("owner_id") != F.col("submitter_id"), F.col("owner_id"))
    first = F.coalesce("first", other("tops"), owner, other("backstop"))
    return of.select("item_id", first.alias("first_owner"), F.coalesce(F.get("closers", F.lit(0)), "last", F.get("tops", F.lit(0))).alias("end_owner"))


def stale(items: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    return items.where((F.col("status") == "open") & (F.col("created_at") <= now - F.make_dt_interval(hours=F.lit(hours))))


def swept(documents: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Documents that have been processing for too long have failed."""
    stuck = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return documents.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def dedup_key(recipient: Column, event: Column, resource: Column, day: Column) -> Column:
    return F.sha2(F.concat_ws("|", recipient, event, F.coalesce(resource, F.lit("")), day), 256)


def category(event: Column) -> Column:
    return reduce(lambda w, e: w.when(event == e, P.EVENT_CATEGORY[e]), P.EVENT_CATEGORY, F).otherwise("review")


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """The window may wrap midnight; none if an end is null or both are equal."""
    same_day = (hour >= start) & (hour < end)
    return F.when(start.isNull() | end.isNull() | (start == end), False).when(start < end, same_day).otherwise((hour >= start) | (hour < end))


def notifications(events: DataFrame, members: DataFrame, screens: DataFrame, prefs: DataFrame) -> DataFrame:
    """Events that reach an inbox, one per recipient, event, resource and day.

    Without recipient, to oneself, across firms, behind a screen or in a muted category nothing is sent.
    events: event_id, event, actor_id, recipient_id, firm_id, vault_id, resource_id, at.
    """
    sent = events.where(F.col("recipient_id").isNotNull() & F.col("event").isNotNull()).where(~F.col("recipient_id").eqNullSafe(F.col("actor_id")))
    same_firm = members.select(F.col("user_id").alias("recipient_id"), "firm_id")
    walled = screens.where("removed_at is null").select(F.col("user_id").alias("recipient_id"), "vault_id")
    muted = prefs.select(F.col("user_id").alias("recipient_id"), F.explode("muted").alias("category"))
    kept = sent.join(same_firm, ["recipient_id", "firm_id"], "left_semi").join(walled, ["recipient_id", "vault_id"], "left_anti")
    kept = kept.withColumn("category", category(F.col("event"))).join(muted, ["recipient_id", "category"], "left_anti")
    keyed = kept.withColumn("dedup_key", dedup_key(F.col("recipient_id").cast("string"), F.col("event"), F.col("resource_id").cast("string"), F.date_format("at", "yyyy-MM-dd")))
    first = Window.partitionBy("dedup_key").orderBy("at", "event_id")
    return keyed.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("event_id", "recipient_id", "category", "dedup_key")


def recipient(event: Column, owner: Column, submitter: Column) -> Column:
    return F.when(event.isin("review.approved", "review.changes_requested", "review.released"), submitter).otherwise(owner)


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no spaces; every value is a string."""
    fields = []
    for c in sorted(columns):
        fields.append(F.concat(F.lit(f'"{c}":"'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), 256)


def row_hash(previous: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), content), 256)


def signed(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with seq, content_hash, prev_hash and row_hash: each row's hash takes in the one before, so a key's rows are folded in order."""
    hashed = rows.withColumn("content_hash", content_hash(columns))
    schema = T.StructType([*hashed.schema.fields, T.StructField("seq", T.IntegerType()), T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        previous, links = "", []
        for content in group["content_hash"]:
            link = hashlib.sha256((previous + content).encode()).hexdigest()
            links.append((previous or None, link))
            previous = link
        return group.assign(seq=range(1, len(group) + 1), prev_hash=[a for a, _ in links], row_hash=[b for _, b in links])

    return hashed.groupBy(key).applyInPandas(fold, schema)


def verified_chain(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: rows, whether sequence, links and hashes hold, and the first place that breaks.

    rows: key, seq, prev_hash, content_hash, row_hash and the signed columns.  Each row is checked against the one before.
    """
    order = Window.partitionBy(key).orderBy("seq")
    broken = (
        (F.col("seq") != F.row_number().over(order)) | ~F.coalesce("prev_hash", F.lit("")).eqNullSafe(F.coalesce(F.lag("row_hash").over(order), F.lit("")))
        | (F.col("content_hash") != content_hash(columns)) | (F.col("row_hash") != row_hash(F.col("prev_hash"), F.col("content_hash")))
    )
    judged = rows.withColumn("__broken", broken)
    return judged.groupBy(key).agg(F.count("*").alias("rows"), F.min(F.when(F.col("__broken"), F.col("seq"))).alias("first_break")).withColumn("valid", F.col("first_break").isNull())


def erased(rows: DataFrame, mine: Column, columns: list[str], preserved: Column) -> DataFrame:
    """The rows with the person's content masked, except preserved kinds."""
    return rows.withColumns({c: F.when(mine & ~preserved, F.lit("[erased]")).otherwise(F.col(c)) for c in columns})


def vault_owner(requests: DataFrame, vaults: DataFrame, members: DataFrame, staffed: DataFrame, screens: DataFrame) -> DataFrame:
    """(user_id, vault_id, owner): oneself for one's own vault; its owner where firm and staffing allow and no screen stands; else null."""
    v = vaults.select("vault_id", "owner_id", F.col("firm_id").alias("vault_firm"))
    m = members.select("user_id", "firm_id")
    s = staffed.select("user_id", "vault_id").distinct().withColumn("__staffed", F.lit(True))
    w = screens.where("removed_at is null").select("user_id", "vault_id").distinct().withColumn("__walled", F.lit(True))
    j = requests.join(v, "vault_id", "left").join(m, "user_id", "left").join(s, ["user_id", "vault_id"], "left").join(w, ["user_id", "vault_id"], "left")
    allowed = (F.col("vault_firm") == F.col("firm_id")) & F.coalesce("__staffed", F.lit(False)) & ~F.coalesce("__walled", F.lit(False))
    return j.select("user_id", "vault_id", F.when(F.col("owner_id") == F.col("user_id"), F.col("user_id")).when(allowed, F.col("owner_id")).alias("owner"))


def set_drift(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(key, drift): used but not declared is missing, declared but not used is extra."""
    missing = used.join(declared, "key", "left_anti").distinct().withColumn("drift", F.lit("missing"))
    return missing.unionByName(declared.join(used, "key", "left_anti").distinct().withColumn("drift", F.lit("extra")))


def active_invites(invites: DataFrame, now: Column) -> DataFrame:
    """The open invite of each firm and e-mail address, the latest if there are several."""
    live = invites.where("accepted_at is null").where(F.col("expires_at") > now)
    latest = Window.partitionBy("firm_id", F.lower("email")).orderBy(F.desc("expires_at"), "token_hash")
    return live.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def member_removed(items: DataFrame, members: DataFrame, leaving, heir) -> tuple[DataFrame, DataFrame]:
    """Items handed to the heir, and the members without the one who leaves."""
    handed = items.withColumn("owner_id", F.when(F.col("owner_id") == F.lit(leaving), F.lit(heir)).otherwise(F.col("owner_id")))
    return handed, members.where(F.col("user_id") != F.lit(leaving))


def role_counts(members: DataFrame, role: str) -> DataFrame:
    """Members of a role per firm; a firm with one must keep it."""
    return members.groupBy("firm_id").agg(F.count_if(F.col("role") == role).alias("n"))


def unread(notifications: DataFrame) -> DataFrame:
    """(user_id, unread): how many notifications of each user have no read_at; users who have read all have 0."""
    return notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))
