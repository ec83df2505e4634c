"""Versioned corpora: line reflow, statute parsing, validation, completeness against the table of contents, versions in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import splitters
from folioscope.operators.common import small, written
from folioscope.operators.retrieval import dense_top, top_per

INSTRUMENT_TYPES = ("constitution", "statute", "regulation", "case_law", "guideline")


def reflowed(lines: DataFrame, is_opener: Column) -> DataFrame:
    """(doc_id, para_ix, text): lines joined by spaces until the next opener or blank line."""
    here = Window.partitionBy("doc_id").orderBy("elem_ix")
    bare = lines.withColumn("text", F.trim("text"))
    blank = F.col("text") == ""
    after_blank = F.coalesce(F.lag("text").over(here) == "", F.lit(True))
    starts = ~blank & (is_opener | after_blank)
    kept = bare.withColumn("__start", starts).withColumn("para_ix", F.sum(F.col("__start").cast("int")).over(here)).where("text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("elem_ix", "text")))
    return kept.groupBy("doc_id", "para_ix").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def title_body(text: Column, most: int = 120) -> tuple[Column, Column]:
    """Title and body, parted at the first long dash, else at the first full stop within ``most`` characters."""
    dash = F.regexp_extract(text, r"^(.*?)\s*[.]?[—–]\s*(.*)$", 1)
    by_dash = (dash != "") & (F.length(dash) <= most)
    stop = F.instr(text, ".")
    by_stop = (stop > 0) & (stop <= most)
    title = F.when(by_dash, dash).when(by_stop, F.substr(text, F.lit(1), stop - 1)).otherwise("")
    body = F.when(by_dash, F.regexp_extract(text, r"^(.*?)\s*[.]?[—–]\s*(.*)$", 2)).when(by_stop, F.ltrim(F.substr(text, stop + 1))).otherwise(text)
    return F.trim(title), body


def toc_and_body(text: Column, title: str) -> tuple[Column, Column]:
    """A document split where its title stands for the second time; without a second time all is body."""
    first = F.locate(title, text)
    second = F.call_function("locate", F.lit(title), text, first + F.length(F.lit(title)))
    found = (first > 0) & (second > 0)
    return F.when(found, F.substr(text, F.lit(1), second - 1)).otherwise(""), F.when(found, F.substr(text, second)).otherwise(text)


def problems(rows: DataFrame) -> Column:
    """What a provision lacks, in fixed order."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [
        (blank("source_key"), "missing source_key"), (~F.coalesce(F.col("instrument_type").isin(*INSTRUMENT_TYPES), F.lit(False)), "unknown instrument_type"),
        (blank("citation"), "missing citation"), (blank("section_or_article_id"), "missing section_or_article_id"), (blank("text"), "empty text"),
        (F.col("as_of_date").isNull(), "missing as_of_date"),
    ]
    return F.filter(F.array(*(F.when(c, m) for c, m in checks)), lambda x: x.isNotNull())


def inherited(provisions: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """Provisions with what they leave open taken from their source."""
    given = sources.select("source_key", *(F.col(c).alias(f"__{c}") for c in columns))
    joined = provisions.join(given, "source_key", "left")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def is_current(repealed: Column, superseded_by: Column) -> Column:
    return ~F.coalesce(repealed, F.lit(False)) & (F.coalesce(F.trim(superseded_by), F.lit("")) == "")


def in_force(when: Column, enacted: Column, as_of: Column, current: Column) -> Column:
    """True, false, or null where nothing can be said: before enactment false, after the snapshot null, else whether current."""
    return F.when(when.isNull(), current).when(when < enacted, False).when(when > as_of, F.lit(None).cast("boolean")).otherwise(current)


def as_of_filter(rows: DataFrame, when: Column) -> DataFrame:
    """Rows in force on the date, with ``withheld``: how many rows of the query could not be vouched for."""
    state = in_force(when, F.col("enacted_date"), F.col("as_of_date"), is_current(F.col("repealed"), F.col("superseded_by")))
    judged = rows.withColumn("in_force", state)
    withheld = F.count_if(F.col("in_force").isNull()).over(Window.partitionBy("query_id"))
    return judged.withColumn("withheld", withheld).where("in_force")


#: Days since the first of the year 1 in binary; every date has fewer than 2 to the power of this.
DAY_BITS = 22
#: Nodes of questions' dates that are sent to every task: dates of 1300 years have fewer.
MOST_NODES = 1_000_000


def day_number(date: Column) -> Column:
    return F.date_diff(date, F.lit("0001-01-01").cast("date")).cast("long")


def date_nodes(date: Column) -> Column:
    """The nodes that a date lies under in the binary tree over all days, from its leaf to the root (1); a null date has node 0."""
    leaf = day_number(date) + (1 << DAY_BITS)
    return F.when(date.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*(F.shiftright(leaf, n) for n in range(DAY_BITS + 1))))


def interval_nodes(first: Column, last: Column) -> Column:
    """The nodes whose days make up the interval, both ends included, null ends open, and node 0: a date lies under one of them
    if it is within the interval, and under none otherwise.  At most two nodes on each level."""
    a, b = F.coalesce(day_number(first), F.lit(0)), F.coalesce(day_number(last), F.lit((1 << DAY_BITS) - 1))
    nodes = [F.lit(0).cast("long")]
    for level in range(DAY_BITS + 1):
        low, high = F.shiftright(a + ((1 << level) - 1), level), F.shiftright(b + 1, level)
        base = 1 << (DAY_BITS - level)
        nodes += [F.when((low < high) & (low % 2 == 1), low + base), F.when((low < high) & (high % 2 == 1), high - 1 + base)]
    return F.array_compact(F.array(*nodes))


def as_of_search(rows: DataFrame, questions: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """(query_id, id, score, rank, withheld): the ``k`` nearest versions (id, embedding, enacted_date, as_of_date, repealed,
    superseded_by) that can be vouched for on each question's (query_id, query_vector, as_of) date; a null date asks for what is current.

    2k rows are fetched; ``withheld`` counts those among them that can't be vouched for.  Where fewer than ``k`` are left, the
    question is asked again among versions in force only: a version goes to the nodes of its interval in a tree of days, a question
    to those above its date, and they meet in one node exactly if the version is in force.  Versions go only to nodes that a question
    has, so with one date each is searched once at most.  Ids are unique; a question without any version in force has no row.
    """
    asked = questions.where("query_id is not null and query_vector is not null").select("query_id", "query_vector", "as_of")
    current = is_current(F.col("repealed"), F.col("superseded_by"))
    versions = rows.select(id_col, "enacted_date", "as_of_date", current.alias("current"))
    state = F.coalesce(in_force(F.col("as_of"), F.col("enacted_date"), F.col("as_of_date"), F.col("current")), F.lit(False))
    fetched = dense_top(rows, asked, 2 * k, id_col).join(versions, id_col).join(asked.select("query_id", "as_of"), "query_id")
    fetched = written(fetched.select("query_id", id_col, "score", state.alias("holds")), "fetched")
    per = fetched.groupBy("query_id").agg(F.count_if(~F.col("holds")).alias("withheld"), F.count_if("holds").alias("held"), F.count("*").alias("n"))
    short = per.where((F.col("held") < k) & (F.col("n") == 2 * k)).select("query_id")
    enough = top_per(fetched.where("holds").join(short, "query_id", "left_anti").drop("holds"), ["query_id"], k, id_col)
    again = asked.join(short, "query_id", "left_semi").select("query_id", "query_vector", F.explode(date_nodes(F.col("as_of"))).alias("node"))
    in_nodes = rows.where(current).select(id_col, "embedding", F.explode(interval_nodes(F.col("enacted_date"), F.col("as_of_date"))).alias("node"))
    in_nodes = in_nodes.join(small(again.select("node").distinct(), MOST_NODES), "node", "left_semi")
    deep = dense_top(in_nodes, again, k, id_col, meet="node")
    return enough.unionByName(deep.select(enough.columns)).join(per.select("query_id", "withheld"), "query_id")


def completeness(toc: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per source (toc: source_key, id; parsed the same): ids of the table of contents, missing ones, coverage."""
    wanted, found = toc.distinct(), parsed.distinct()
    missing = wanted.join(found, ["source_key", "id"], "left_anti").groupBy("source_key").agg(F.count("*").alias("n_missing"), F.array_sort(F.collect_list("id")).alias("missing"))
    total = wanted.groupBy("source_key").agg(F.count("*").alias("toc_total"))
    seen = found.groupBy("source_key").agg(F.count("*").alias("parsed_total"))
    per = seen.join(total, "source_key", "full_outer").join(missing, "source_key", "left").fillna(0, ["toc_total", "parsed_total", "n_missing"])
    share = F.when(F.col("toc_total") > 0, 1 - F.col("n_missing") / F.col("toc_total")).otherwise((F.col("parsed_total") > 0).cast("double"))
    return per.withColumn("coverage", F.round(share, 6)).withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def latest_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, left_id: str) -> DataFrame:
    """As-of join: per row of ``left`` the latest row of ``right`` with the same key at or before its time.

    Both sides are united and one running ``last`` over time carries the right row along, so keys are sorted once and no
    pairs are made; among right rows of one time the last in column order wins.
    """
    carried = F.struct(F.col(right_ts), *(F.col(c) for c in right.columns if c not in (key, right_ts)))
    a = left.select(F.col(key), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).alias("__right"))
    b = right.select(F.col(key), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).alias("__left"), carried.alias("__right"))
    both = a.withColumn("__right", F.lit(None).cast(b.schema["__right"].dataType)).unionByName(b.withColumn("__left", F.lit(None).cast(a.schema["__left"].dataType)))
    order = Window.partitionBy(key).orderBy("__ts", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("__right", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
    return merged.select("__left.*", F.col("__right").alias("matched"))


def upserted(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``incoming`` put in by key."""
    return incoming.unionByName(current.join(incoming.select(*key).distinct(), key, "left_anti"))


def statutes(lines: DataFrame) -> DataFrame:
    """``StatuteFold`` per source, row by row; lines: source_key, elem_ix, text, toc_ids (array, null without a table of contents)."""
    return splitters.statutes(lines)


def articles(lines: DataFrame) -> DataFrame:
    """Articles and schedules of constitutions (source_key, elem_ix, text): source_key, ix, kind, id, part, part_title, title, text,
    repealed.

    Each line has a kind; those that open something begin a group, and a group that an article or a schedule opened is a
    provision, its other lines the body.  Numbered lines within a schedule, and those without a heading's dash or the form
    of a repealed stub (footnotes), are body lines.  Articles that a line says are gone are marked; of repeated ids the
    first stays.
    """
    here = Window.partitionBy("source_key").orderBy("elem_ix")
    line = lines.select("source_key", "elem_ix", F.trim("text").alias("text")).where("text <> ''")
    text, rest = F.col("text"), F.regexp_extract("text", P.ARTICLE_LINE, 2)
    opens = text.rlike(P.ARTICLE_LINE) & (rest.rlike(P.ARTICLE_HEAD) | rest.rlike(P.ARTICLE_STUB))
    first = (
        F.when(text.rlike(P.ARTICLE_GONE) & ~text.rlike(P.ARTICLE_LINE), "gone").when(text.rlike(P.PART_LINE), "part")
        .when(text.rlike(P.SCHEDULE_LINE), "schedule").when(opens, "article").otherwise("body")
    )
    line = line.withColumn("first", first)
    within = F.last(F.when(F.col("first").isin("part", "schedule"), F.col("first")), ignorenulls=True).over(here)
    heading = (F.lag("first").over(here) == "part") & (text == F.upper("text")) & (text != F.lower("text"))
    kind = F.when(F.coalesce(heading, F.lit(False)), "heading").when((F.col("first") == "article") & (within == "schedule"), "body").otherwise(F.col("first"))
    line = line.withColumn("kind", F.when(kind.isNull(), F.col("first")).otherwise(kind))
    line = line.withColumn("part", F.last(F.when(F.col("kind") == "part", F.upper(F.regexp_extract("text", P.PART_LINE, 1))), ignorenulls=True).over(here))
    line = line.withColumn("opened", F.sum(F.col("kind").isin("part", "schedule", "article").cast("int")).over(here))
    titles = line.where("kind = 'heading'").groupBy("source_key", "opened").agg(F.min("text").alias("part_title"))
    heads = line.where("kind = 'part'").join(titles, ["source_key", "opened"], "left").groupBy("source_key", "part").agg(F.min_by("part_title", "elem_ix").alias("part_title"))
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct("elem_ix", "text"))))
    groups = line.where(F.col("kind").isin("schedule", "article", "body")).groupBy("source_key", "opened").agg(
        F.max(F.when(F.col("kind") != "body", F.struct("kind", "text", "part"))).alias("o"), F.min("elem_ix").alias("at"), F.array_join(F.transform(said, lambda b: b["text"]), " ").alias("more"),
    ).where("o is not null")
    rest = F.regexp_extract("o.text", P.ARTICLE_LINE, 2)
    article, stub = F.col("o.kind") == "article", rest.rlike(P.ARTICLE_STUB)
    title, body = title_body(rest)
    name = F.regexp_extract("o.text", P.SCHEDULE_LINE, 1)
    found = groups.select(
        "source_key", "at", F.col("o.kind").alias("kind"), F.when(article, F.regexp_extract("o.text", P.ARTICLE_LINE, 1)).otherwise(F.concat(F.lit("Schedule."), F.upper(name))).alias("id"),
        F.when(article, F.col("o.part")).alias("part"),
        F.when(~article, F.concat(F.initcap(name), F.lit(" Schedule"))).when(stub, F.rtrim(F.regexp_extract(rest, P.ARTICLE_STUB, 1), F.lit("."))).otherwise(title).alias("title"),
        F.trim(F.concat_ws(" ", F.when(article, F.when(stub, F.regexp_extract(rest, P.ARTICLE_STUB, 2)).otherwise(body)), F.col("more"))).alias("text"), (article & stub).alias("stub"),
    )
    first_of = Window.partitionBy("source_key", "id").orderBy("at")
    found = found.withColumn("place", F.row_number().over(first_of)).where("place = 1")
    gone = line.where("kind = 'gone'").select("source_key", F.regexp_extract("text", P.ARTICLE_GONE, 1).alias("id"), F.lit(True).alias("gone")).distinct()
    whole = found.join(gone, ["source_key", "id"], "left").join(heads, ["source_key", "part"], "left")
    numbered = whole.withColumn("ix", F.row_number().over(Window.partitionBy("source_key").orderBy("at")))
    return numbered.select("source_key", "ix", "kind", "id", "part", "part_title", "title", "text", (F.col("stub") | F.coalesce("gone", F.lit(False))).alias("repealed"))


def cites(text: Column, section_id: Column) -> Column:
    """Whether an answer names the provision's id as a whole; null without an id."""
    return F.when(F.coalesce(section_id, F.lit("")) != "", F.concat(F.lit(" "), F.regexp_replace(text, "[^A-Za-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), section_id, F.lit(" "))))
