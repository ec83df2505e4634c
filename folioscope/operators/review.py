"""What answers are put together from: spans, claims, ledgers, comparisons, budgets, and the scores they are judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names and hints of matter kinds in order of precedence; one word is a token, several are a phrase.
MATTER_HINTS = {
    "litigation": "complaint|petition|plaint|writ|pleading|affidavit|summons|litigation|lawsuit|vs|versus",
    "arbitration": "arbitration|arbitral|award|siac|icc|uncitral|lcia",
    "m&a": "merger|acquisition|share purchase|spa|asset purchase|apa|stock purchase|ma|scheme of arrangement|shareholders agreement|sha",
    "lending": "facility|loan|credit agreement|debenture|security|guarantee|mortgage|hypothecation|promissory",
    "ip": "license|licence|licensing|trademark|patent|copyright|royalty|ip assignment|technology transfer|franchise",
    "employment": "employment|offer letter|appointment|non compete|noncompete|hr policy|severance|consultancy",
    "regulatory": "regulator|sebi|rbi|filing|circular|approval|notification|regulatory",
    "compliance": "compliance|policy|code of conduct|kyc|aml|data protection|privacy policy",
}


def matter_kind(doc_type: Column, filename: Column) -> Column:
    """The first kind with a whole word or phrase in the name; none for financial filings."""
    name = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(filename, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    kind = F.coalesce(*(F.when(name.rlike(f" ({hints}) "), k) for k, hints in MATTER_HINTS.items()))
    return F.when(F.coalesce(doc_type, F.lit("generic")).isin("legal_contract", "mixed", "generic"), kind)


def without_privileged(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce("privileged", F.lit(False)))


def warned(spans: DataFrame, grades: DataFrame) -> DataFrame:
    """``fidelity_warning`` where the document's grade is known and not good."""
    return spans.join(grades, "doc_id", "left").withColumn("fidelity_warning", F.coalesce("grade", F.lit("good")) != "good").drop("grade")


def known_tools(asked: Column, allowed: Column) -> Column:
    """The asked names that are allowed, in the order asked."""
    return F.array_intersect(asked, allowed)


def comparison_input(chunks: DataFrame, most_chunks: int = 8, most_chars: int = 3000) -> DataFrame:
    """Per document the first chunks, parted by blank lines, in ``most_chars`` characters."""
    first = Window.partitionBy("doc_id").orderBy("chunk_index")
    kept = chunks.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most_chunks)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return kept.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), 1, most_chars).alias("text"))


def comparison_points(texts: DataFrame, key: str) -> DataFrame:
    """(key, section, ix, point): bullets under the last line that ends with a colon or begins with #."""
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("ix", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    head = F.col("line").startswith("#") | F.col("line").endswith(":")
    above = Window.partitionBy(key).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(head, F.trim(F.regexp_replace("line", r"^#+\s*|:+$", ""))), ignorenulls=True).over(above)
    bullets = rows.withColumn("section", section).where(F.col("line").rlike(r"^[-*•]\s"))
    return bullets.select(key, "section", "ix", F.regexp_replace("line", r"^[-*•]\s+", "").alias("point"))


def spans_to_chunks(spans: DataFrame, chunks: DataFrame, probe: int = 60) -> DataFrame:
    """(span_id, doc_id, chunk_index): the first chunk of the document that holds the span's beginning, else its first chunk."""
    begin = F.lower(F.substring(F.trim("span"), 1, probe))
    pairs = spans.join(chunks.select("doc_id", "chunk_index", "text"), "doc_id").withColumn("__hit", (begin != "") & F.lower("text").contains(begin))
    return pairs.groupBy("span_id", "doc_id").agg(F.coalesce(F.min(F.when(F.col("__hit"), F.col("chunk_index"))), F.min("chunk_index")).alias("chunk_index"))


def claims_by_document(claims: DataFrame) -> DataFrame:
    """Claims (claim_ix, claim, doc_ids) regrouped under each document of their evidence, in order."""
    per = claims.withColumn("doc_id", F.explode(F.array_distinct("doc_ids")))
    parts = F.array_sort(F.collect_list(F.struct("claim_ix", "claim")))
    return per.groupBy("doc_id").agg(F.transform(parts, lambda c: c["claim"]).alias("claims"))


def claim_rows(claims: DataFrame) -> DataFrame:
    """(doc_id, position, claim): as ``claims_by_document``, a row for each claim, for documents of any size."""
    per = claims.withColumn("doc_id", F.explode(F.array_distinct("doc_ids")))
    return per.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("claim_ix", "claim")).alias("position"), "claim")


LEDGER_KEY = ["doc", "page", "label", "period", "chunk_id"]


def ledger_rows(envelopes: DataFrame) -> DataFrame:
    """One row per provenance item of each envelope (run_id, step, provenance); items without kind are spans."""
    rows = envelopes.select("run_id", "step", F.posexplode("provenance").alias("ix", "p")).where("p is not null")
    return rows.select("run_id", "step", "ix", "p.*").withColumn("kind", F.coalesce("kind", F.lit("span")))


def ledger_sources(ledger: DataFrame) -> DataFrame:
    """Distinct sources of each run in the order first seen; parameters are none."""
    kept = ledger.where("kind <> 'param'")
    seen = kept.groupBy("run_id", *LEDGER_KEY).agg(F.min(F.struct("step", "ix")).alias("__first"))
    return seen.withColumn("source_id", F.row_number().over(Window.partitionBy("run_id").orderBy("__first"))).drop("__first")


def exhausted(steps: DataFrame, budgets: DataFrame) -> DataFrame:
    """``exhausted`` of each step (run_id, mode, step, tokens, seconds) against its mode's most steps, tokens and seconds."""
    here = Window.partitionBy("run_id").orderBy("step")
    used = steps.withColumns({"used_tokens": F.sum("tokens").over(here), "used_seconds": F.sum("seconds").over(here)})
    over = (F.col("step") >= F.col("most_steps")) | (F.col("used_tokens") >= F.col("most_tokens")) | (F.col("used_seconds") >= F.col("most_seconds"))
    return used.join(F.broadcast(budgets), "mode").withColumn("exhausted", over)  # budgets: one row per mode


def abstain_causes(events: DataFrame) -> DataFrame:
    """Per abstained run the first cause in its journal: no retrieval, a failed gate, a budget, else unknown."""
    cause = F.when(F.col("kind") == "empty_search", "no_evidence").when(F.col("kind") == "gate_fail", "gate").when(F.col("kind") == "budget", "budget")
    per = events.withColumn("cause", cause).groupBy("run_id").agg(F.bool_or(F.col("kind") == "abstain").alias("abstained"), F.min(F.when(F.col("cause").isNotNull(), F.struct("step", "cause"))).alias("first"))
    return per.where("abstained").select("run_id", F.coalesce("first.cause", F.lit("unknown")).alias("cause"))


def extraction_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: shares of true cells (doc, section, label, period, value) found at all and found with the right value."""
    key = ["doc", "section", "label", "period"]
    joined = truth.select(*key, F.col("value").alias("want")).join(found.select(*key, F.col("value").alias("got")), key, "left")
    right = F.coalesce(F.abs(F.col("got") - F.col("want")) <= 1e-9, F.lit(False))
    return joined.groupBy("doc").agg(F.round(F.avg(F.col("got").isNotNull().cast("int")), 6).alias("coverage"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


def latency_percentiles(runs: DataFrame, by: str) -> DataFrame:
    """p50 and p95 as the values at those places of the sorted list, without interpolation."""
    counts = runs.groupBy(by, "seconds").agg(F.count("seconds").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(by).orderBy("seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = counts.groupBy(F.col(by).alias("__by")).agg(F.sum("__c").alias("__n"))
    ranked = counts.withColumn("__upto", upto).join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    at = lambda q: F.min(F.when(F.col("__upto") >= F.least(F.col("__n"), F.floor(F.col("__n") * q) + 1), F.col("seconds")))
    return ranked.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def corroborated(results: DataFrame, prose: DataFrame) -> DataFrame:
    """``corroborated``: whether the raw figure's digits and separators stand in a text of its document."""
    marked = results.withColumn("__d", F.regexp_replace("raw", "[^0-9,]", ""))
    asked = marked.select("doc", "__d").where("__d <> ''").distinct()
    hits = asked.join(prose.select("doc", "text"), "doc").where(F.col("text").contains(F.col("__d"))).select("doc", "__d").distinct()
    joined = marked.join(hits.withColumn("__hit", F.lit(True)), ["doc", "__d"], "left")
    return joined.select(*results.columns, F.coalesce("__hit", F.lit(False)).alias("corroborated"))


def result_table(results: DataFrame) -> DataFrame:
    """(result_id, line): a Markdown row for each result, bars escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    return results.select("result_id", F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in results.columns if c != "result_id")), F.lit(" |")).alias("line"))


def review_queue(items: DataFrame, owner) -> DataFrame:
    """What a reviewer still has to do, the latest first."""
    return items.where(F.col("status").isin("awaiting", "changes_requested") & (F.col("owner_id") == F.lit(owner))).orderBy(F.desc("created_at"), "item_id")


def playbook(rows: DataFrame, positions: DataFrame, doc_type: str) -> DataFrame:
    """Rows of a document type with the user's position, where there is one, over the standard."""
    own = positions.select("topic", F.col("position").alias("__own"))
    return rows.where(F.col("doc_type") == doc_type).join(own, "topic", "left").select("topic", F.coalesce("__own", "standard").alias("position"), F.col("__own").isNotNull().alias("overridden"))


def with_default(requests: DataFrame, templates: DataFrame, key: str, default: str) -> DataFrame:
    """Each request with the template of its kind, whatever the case, else the default's."""
    named = templates.select(F.lower(key).alias("__key"), "template")
    fallback = named.where(F.col("__key") == default).select(F.col("template").alias("__default"))
    joined = requests.withColumn("__key", F.lower(key)).join(named, "__key", "left").join(F.broadcast(fallback), how="left")  # one row
    return joined.select(*requests.columns, F.coalesce("template", "__default").alias("template"))


def export_manifest(tables: dict[str, DataFrame], user) -> DataFrame:
    """Rows of a person in each table (which has user_id)."""
    rows = [t.where(F.col("user_id") == F.lit(user)).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def deletable(rows: DataFrame, now: Column, retention_days: int = 365, answer_days: int = 90) -> DataFrame:
    """``due`` of each request, and whether its data is older than the retention floor."""
    return rows.withColumns({"due": F.date_add(F.to_date("requested_at"), answer_days), "deletable": F.to_date("created_at") <= F.date_sub(F.to_date(now), retention_days)})


def rendered(template: Column, params: Column) -> Column:
    """A template with each {name} replaced from a map of strings; names that the map lacks, or has as null, become nothing."""
    filled = F.aggregate(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.trim(F.regexp_replace(filled, r"\{[A-Za-z_][A-Za-z0-9_]*\}", ""))


def request_columns(items: Column, most: int = 10) -> Column:
    """The columns of a grid that a free text asks for, one per line that is not blank: key, label (40 characters) and kind."""
    asked = F.slice(F.filter(F.transform(F.split(F.replace(F.coalesce(items, F.lit("")), F.lit("\\n"), F.lit("\n")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return F.transform(asked, lambda x, i: F.struct(F.concat(F.lit("item_"), i.cast("string")).alias("key"), F.substring(x, 1, 40).alias("label"), F.lit("clause").alias("kind")))
