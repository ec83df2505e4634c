"""Verification: figures against cells, citations, grounding, redaction, coverage, run health, evaluation."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from folioscope.functions import patterns as P
from folioscope.operators.kernel import parse_cell

SCALES = (1.0, 1e-3, 1e3, 1e-6, 1e6)


def without_citations(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), P.CITATION, " ")


def sentences(texts: DataFrame, key: str) -> DataFrame:
    """(key, sent_ix, sentence): by lines, then after sentence ends followed by white space; blanks go."""
    marked = F.regexp_replace("text", r"([.!?])[ \t\r\f]+", "$1\n")
    return texts.select(key, F.posexplode(F.split(marked, "\n")).alias("sent_ix", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def figures(texts: DataFrame, key: str) -> DataFrame:
    """(key, token, x): distinct substantive figures of each text: with comma, point or dollar, or at least 10 000."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(P.FIGURE), F.lit(0)))).alias("token")).withColumn("token", F.trim("token"))
    x = F.regexp_replace("token", r"[$,\s]", "").try_cast("double")
    kept = found.distinct().withColumn("x", x).where("x is not null")
    return kept.where(F.col("token").rlike(r"[,.$]") | (F.col("x") >= 10_000))


def has_substantive_figure(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(P.FIGURE), F.lit(0))
    return F.exists(tokens, lambda t: F.trim(t).rlike(r"[,.$]") | (F.coalesce(F.regexp_replace(t, r"\s", "").try_cast("double"), F.lit(0.0)) >= 10_000))


def bin_of(x: Column, tolerance: float) -> Column:
    """The bin of a number that is not negative: linear below 1, logarithmic above.  Numbers within ``tolerance`` times the
    larger of 1 and either of them are in the same or in neighbour bins."""
    steps = F.when(x < 1, x / tolerance).otherwise(1 / tolerance + F.log(x) / F.log1p(F.lit(tolerance)))
    return F.floor(steps / 2)


def traced(found: DataFrame, cells: DataFrame, key: str, tolerance: float = 0.01, scales: tuple[float, ...] = SCALES, least: float = 1.0) -> DataFrame:
    """``found`` (key, token, x) with ``traces``: whether some cell (value), at some scale, is within the relative tolerance.

    Cells below ``least`` count as ``least`` when the tolerance is taken.  With a ``least`` of 0 cells of 0 stand for what is
    below the tolerance; else they stand for nothing.

    The join is on bins: each scaled value is put in its bin and both neighbours, so it is an equi join, and
    values of one bin are pre-aggregated to their distinct ones.
    """
    scaled = cells.select(F.explode(F.array(*(F.abs("value") * s for s in scales))).alias("v")).where("v > 0" if least else "v >= 0").distinct()
    binned = scaled.withColumn("bin", F.explode(F.array(*(bin_of(F.col("v"), tolerance) + d for d in (-1, 0, 1)))))
    near = F.abs(F.col("x") - F.col("v")) <= tolerance * F.greatest(F.col("v"), F.lit(least))
    near = near if least else near | ((F.col("v") == 0) & (F.col("x") < tolerance))
    asked = found.withColumn("bin", bin_of(F.col("x"), tolerance))
    hits = asked.join(binned, "bin").where(near).select(key, "token").distinct().withColumn("traces", F.lit(True))
    return found.join(hits, [key, "token"], "left").withColumn("traces", F.coalesce("traces", F.lit(False)))


def numbers(texts: DataFrame, key: str) -> DataFrame:
    """(key, token, x): the distinct numbers of each text by size, without years and without whole numbers below 100."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(P.ANSWER_NUMBER), F.lit(0)))).alias("token"))
    kept = found.where(~F.regexp_replace("token", r"^[()$%,]+|[()$%,]+$", "").rlike(r"^(19|20)\d{2}$")).withColumn("x", F.abs(parse_cell(F.col("token"))))
    return kept.where("x is not null").where(F.col("token").rlike("[.,]") | (F.col("x") >= 100))


def number_check(texts: DataFrame, allowed: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """One row per text (key, text): numbers checked, those that stand for no allowed value, groundedness (1 without numbers), ok.

    allowed: value, of source cells and of computed results; a number stands for one within ``tolerance`` of it, whatever their signs.
    """
    found = numbers(texts, key)
    per = traced(found, allowed, key, tolerance, scales=(1.0,), least=0.0).groupBy(key).agg(F.count("*").alias("checked"), F.count_if(~F.col("traces")).alias("ungrounded"))
    whole = texts.select(key).join(per, key, "left").na.fill(0, ["checked", "ungrounded"])
    share = F.coalesce(F.try_divide(F.col("ungrounded"), F.col("checked")), F.lit(0.0))
    return whole.withColumn("groundedness", F.round(1 - share, 6)).withColumn("ok", F.col("ungrounded") == 0)


def figure_check(texts: DataFrame, cells: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """One row per text (key, text): figures checked and untraced, groundedness (1 without figures), whether cells exist to decide
    by, and ok: figures that nothing can decide on fail, texts without figures pass."""
    any_cell = cells.agg((F.count("value") > 0).alias("decided"))
    found = figures(texts, key)
    per = traced(found, cells, key, tolerance).groupBy(key).agg(F.count("*").alias("checked"), F.count_if(~F.col("traces")).alias("untraced"))
    whole = texts.select(key).join(per, key, "left").join(F.broadcast(any_cell), F.lit(True)).na.fill(0, ["checked", "untraced"])  # any_cell: one row
    ok = F.when(F.col("decided"), F.col("untraced") == 0).otherwise(F.col("checked") == 0)
    share = F.coalesce(F.try_divide(F.col("untraced"), F.col("checked")), F.lit(0.0))
    return whole.withColumn("groundedness", F.round(1 - share, 6)).withColumn("ok", ok)


def is_factual(sentence: Column) -> Column:
    """25 characters at least, no scaffolding, and a digit or a content word once placeholders are gone."""
    bare = F.trim(sentence)
    rest = F.trim(F.regexp_replace(bare, P.INPUT_NEEDED, ""))
    placeholder = F.upper(bare).contains("[INPUT NEEDED")
    digit = rest.rlike(r"\d")
    return (F.length(bare) >= 25) & ~bare.rlike(P.SCAFFOLD) & ~(placeholder & ~digit) & (F.length(rest) >= 25) & (digit | rest.rlike(P.CONTENT_WORD))


def is_cited(sentence: Column) -> Column:
    return sentence.rlike(P.CITATION)


def norm_token(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"^[.'/&-]+|[.'/&-]+$", "")


def content_tokens(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0)), norm_token)
    stop = F.array(*map(F.lit, P.STOPWORDS))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def entity_tokens(text: Column) -> Column:
    """Capitalised content words that do not open the text."""
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9&./'-]+", "")
    caps = F.filter(F.regexp_extract_all(rest, F.lit(P.TOKEN), F.lit(0)), lambda t: t.rlike("^[A-Z]"))
    stop = F.array(*map(F.lit, P.STOPWORDS))
    return F.array_distinct(F.filter(F.transform(caps, norm_token), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def grounded(sentence: Column, evidence: Column, overlap: float = 0.6) -> Column:
    """Whether evidence text echoes a sentence: three content tokens at least, ``overlap`` of them and every entity in it."""
    bare = without_citations(sentence)
    corpus = F.lower(F.coalesce(evidence, F.lit("")))
    tokens, entities = content_tokens(bare), entity_tokens(bare)
    share = F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: corpus.contains(t))), F.size(tokens)), F.lit(0.0))
    return (corpus != "") & (F.size(tokens) >= 3) & F.forall(entities, lambda e: corpus.contains(e)) & (share >= overlap)


#: What a content token consists of, in lower case; a token in a text lies within one run of it.
RUN = re.compile(r"[a-z0-9&./'-]+")


def grounded_pairs(docs: DataFrame, claims: DataFrame, overlap: float = 0.6, block: int = 20_000) -> DataFrame:
    """(item_id, doc_id, share) of each claim (item_id, text) and document (doc_id, text) that holds a share of at least
    ``overlap`` of the claim's three or more content tokens, as parts of words too.

    Documents are scanned once per ``block`` claims, which are broadcast as an index from token to claims.
    """
    spark, toks = docs.sparkSession, claims.select("item_id", content_tokens(F.col("text")).alias("toks")).where(F.size("toks") >= 3)
    n_blocks = max(1, -(-toks.count() // block))

    def scan(at: int) -> DataFrame:
        rows = toks.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == at).collect()
        holders: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for t in r.toks:
                holders.setdefault(t, []).append(i)
        shared = spark.sparkContext.broadcast(([(r.item_id, len(r.toks)) for r in rows], holders, sorted({len(t) for t in holders})))

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items, index, lengths = shared.value
            known: dict[str, tuple] = {}

            def inside(run: str) -> tuple:
                found = known.get(run)
                if found is None:
                    found = tuple({p for n in lengths for i in range(len(run) - n + 1) if (p := run[i : i + n]) in index})
                    if len(run) <= 64:
                        if len(known) >= 200_000:
                            known.clear()
                        known[run] = found
                return found

            for docs in batches:
                out = []
                for doc_id, corpus in zip(docs["doc_id"], docs["corpus"]):
                    hits = Counter(i for t in {t for run in set(RUN.findall(corpus or "")) for t in inside(run)} for i in index[t])
                    out.extend((items[i][0], doc_id, k / items[i][1]) for i, k in hits.items() if k / items[i][1] >= overlap)
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "share"])

        kinds = f"item_id {claims.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, share double"
        return docs.select("doc_id", F.lower("text").alias("corpus")).mapInPandas(pairs, kinds)

    out = scan(0)
    for at in range(1, n_blocks):
        out = out.unionByName(scan(at))
    return out


def redacted(sents: DataFrame, key: str, keep: Column, notice: str) -> DataFrame:
    """Per text the sentences that stay, in order, and the notice if any went."""
    per = sents.withColumn("__keep", keep).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__keep"), F.struct("sent_ix", "sentence")))), lambda s: s["sentence"]), " ").alias("text"),
        F.count_if(~F.col("__keep")).alias("dropped"),
    )
    return per.withColumn("text", F.when(F.col("dropped") > 0, F.trim(F.concat_ws(" ", "text", F.lit(notice)))).otherwise(F.col("text")))


def sections(texts: DataFrame, key: str) -> DataFrame:
    """(key, section_ix, header, body): split at lines that begin with "## "."""
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_ix", "line"))
    head = F.col("line").startswith("## ")
    here = Window.partitionBy(key).orderBy("line_ix")
    numbered = rows.withColumn("section_ix", F.sum(head.cast("int")).over(here))
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct("line_ix", "line"))))
    return numbered.groupBy(key, "section_ix").agg(F.max(F.when(head, F.col("line"))).alias("header"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("body"))


def entities_asked(question: Column) -> Column:
    """The names that a question lists after a word of comparison, or else after "for each", by commas and "and".

    The list ends before what is asked of the names; a label with a colon before it goes.  Fewer than two names are no list.
    """

    def listed(opening: str, closing: str, label: str | None = None) -> Column:
        tail = F.trim(F.try_element_at(F.split(F.trim(question), opening, 2), F.lit(2)))
        tail = tail if label is None else F.regexp_replace(tail, label, "")
        names = F.transform(F.split(F.try_element_at(F.split(tail, closing, 2), F.lit(1)), P.LIST_SPLIT), lambda x: F.trim(x))
        names = F.filter(names, lambda e: e != "")
        return F.when(F.size(names) > 1, names)

    return F.coalesce(listed(P.COMPARING, P.COMPARED_ENDS), listed(P.FOR_EACH, P.EACH_ENDS, P.LIST_LABEL), F.array().cast("array<string>"))


#: A digit, or one of the words as a whole; not ``\\b``, which engines take differently beside letters beyond ASCII.
STATED = r"\d|(^|[^\p{L}\p{N}_])(" + "|".join((*P.RESULT_WORDS, *P.ABSENCE)) + r")([^\p{L}\p{N}_]|$)"


def addressed(answer: Column, entity: Column, reach: int = 200) -> Column:
    """Whether a number, a result word or a statement of absence stands within ``reach`` characters of some mention of the
    entity; true for an empty entity."""

    def of(low: Column, name: Column) -> Column:
        parts = F.split(F.replace(low, name, F.lit("\u0001")), "\u0001")

        def near(at: Column) -> Column:
            start = F.greatest(at - reach, F.lit(1))
            return F.substr(low, start, at + F.length(name) + reach - start).rlike(STATED)

        def step(seen: Column, part: Column) -> Column:  # a mention follows each part; the first that is near decides
            end = seen["end"] + F.length(part)
            return F.struct((end + F.length(name)).alias("end"), F.when(seen["found"], True).otherwise(near(end + 1)).alias("found"))

        start = F.struct(F.lit(0).alias("end"), F.lit(False).alias("found"))
        some = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda seen: seen["found"])
        return F.when(name == "", True).when(F.size(parts) < 2, False).otherwise(some)

    both = F.struct(F.lower(F.coalesce(answer, F.lit(""))).alias("low"), F.lower(F.coalesce(entity, F.lit(""))).alias("name"))
    return F.transform(F.array(both), lambda x: of(x["low"], x["name"]))[0]  # the text is put in lower case once, not at each mention


def completeness(answers: DataFrame, key: str) -> DataFrame:
    """Per answer (key, question, answer): the names that its question lists and the answer leaves out, and whether it passes;
    questions about fewer than two names always do."""
    names = entities_asked(F.col("question"))
    dropped = F.when(F.size(names) > 1, F.filter(names, lambda e: ~addressed(F.col("answer"), e))).otherwise(F.array().cast("array<string>"))
    return answers.select(key, dropped.alias("dropped")).withColumn("complete", F.size("dropped") == 0)


def answer_gates(answers: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """The whole-answer gates on (key, question, answer): figures, citations and completeness, and the names of those that fail.

    A heading that opens the answer is no claim; of the sentences only factual ones with a figure need a citation.
    """
    body = F.regexp_replace(F.coalesce("answer", F.lit("")), r"^\s*#{1,6}[^\n]*\n", "")
    texts = answers.select(key, "question", body.alias("answer"))
    bare = texts.select(key, without_citations(F.col("answer")).alias("text"))
    sents = sentences(texts.select(key, F.col("answer").alias("text")), key)
    s = F.col("sentence")
    bare_claim = is_factual(s) & ~is_cited(s) & has_substantive_figure(without_citations(s))
    cited = sents.groupBy(key).agg(F.count_if(bare_claim).alias("uncited"))
    joined = figure_check(bare, cells, key).select(key, "ok").join(cited, key, "left").join(completeness(texts, key), key).na.fill(0, ["uncited"])
    failed = F.array(F.when(~F.col("ok"), "figures"), F.when(F.col("uncited") > 0, "citations"), F.when(~F.col("complete"), "completeness"))
    return joined.withColumn("failures", F.filter(failed, lambda f: f.isNotNull())).select(key, "uncited", "dropped", "failures", (F.size("failures") == 0).alias("passed"))


def supported_share(sents: DataFrame, key: str, supported: Column, least: int = 25) -> DataFrame:
    """Per text of (key, sentence): the share of its sentences of at least ``least`` characters that is supported; 1 without such."""
    long = F.length("sentence") >= least
    per = sents.groupBy(key).agg(F.count_if(long).alias("long"), F.count_if(long & supported).alias("supported"))
    return per.withColumn("groundedness", F.round(F.coalesce(F.try_divide(F.col("supported"), F.col("long")), F.lit(1.0)), 6))


def partial_answer(entries: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Per run of (key, ix, kind, label, period, doc, page, shown) the lines of what it has verified: cells and results with a
    label, each once in the order of ``ix``, ``most`` of them."""
    some = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    kept = entries.where(F.col("kind").isin("cell", "result") & (some("label") != "") & F.col("shown").isNotNull())
    first = kept.groupBy(key, some("label").alias("label"), some("period").alias("period"), some("doc").alias("doc"), "shown").agg(F.min(F.struct("ix", "page")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at.ix"))).where(F.col("place") <= most)
    page = F.coalesce(F.concat(F.lit(" p."), F.col("at.page").cast("int").cast("string")), F.lit(""))
    cite = F.when(F.col("doc") != "", F.concat(F.lit(" ["), "doc", page, F.lit("]"))).otherwise("")
    said = F.when(F.col("period") != "", F.concat(F.lit(" ("), "period", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- **"), "label", F.lit("**"), said, F.lit(": "), "shown", cite)
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))  # ``most`` each
    return placed.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n_lines"))


def snippet(text: Column, probe: Column, reach: int = 140) -> Column:
    """The surroundings of the probe's first 40 characters, with ellipses; null where the text lacks it."""
    needle = F.substring(probe, 1, 40)
    at = F.call_function("instr", F.lower(text), F.lower(needle))
    start = F.greatest(at - reach, F.lit(1))
    cut = F.substr(text, start, F.length(needle) + (at - start) + reach)
    left = F.when(start > 1, "…").otherwise("")
    right = F.when(start + F.length(cut) <= F.length(text), "…").otherwise("")
    return F.when((at > 0) & (needle != ""), F.concat(left, F.trim(cut), right))


def clean_snippet(text: Column, most: int = 300) -> Column:
    """White space collapsed, cut at a word within ``most`` characters."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.regexp_replace(F.substring(bare, 1, most), r"\s+\S*$", ""), F.lit("…")))


def stated_confidence(answer: Column, groundedness: Column, least: float = 0.45) -> tuple[Column, Column]:
    """Confidence under "## Confidence" (percent above 1) times groundedness, and whether to abstain."""
    said = F.regexp_extract(answer, r"(?is)##\s*Confidence\s*:?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    share = F.when(said > 1, said / 100).otherwise(said)
    value = F.coalesce(share, F.lit(0.5)) * groundedness
    return F.round(value, 6), value < least


def coverage(docs: DataFrame, quorum: float = 0.90) -> DataFrame:
    """Routed, read, relevant and failed documents (columns read, relevant, failed), and whether the quorum was met: a flag, nothing is dropped."""
    per = docs.agg(F.count("*").alias("routed"), F.count_if(F.col("read")).alias("read"), F.count_if(F.col("relevant")).alias("relevant"), F.count_if(F.col("failed")).alias("failed"))
    return per.withColumn("quorum_met", F.coalesce(F.try_divide(F.col("read"), F.col("routed")), F.lit(1.0)) >= quorum)


def sources(spans: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct (doc, chunk) of each answer in the order first seen, numbered from 1."""
    seen = spans.groupBy(key, "doc", "chunk").agg(F.min(order).alias("__first"))
    return seen.withColumn("source_id", F.row_number().over(Window.partitionBy(key).orderBy("__first", "doc", "chunk"))).drop("__first")


def run_health(calls: DataFrame) -> DataFrame:
    """Per run: tools with two calls or more that all failed or were empty, and calls made three times or more alike."""
    tools = calls.groupBy("run_id", "tool").agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("good")).groupBy("run_id").agg(F.count_if((F.col("n") >= 2) & (F.col("good") == 0)).alias("dead_tools"))
    alike = calls.groupBy("run_id", "signature").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count_if(F.col("n") >= 3).alias("repeated_calls"))
    return tools.join(alike, "run_id").withColumn("healthy", (F.col("dead_tools") == 0) & (F.col("repeated_calls") == 0))


def blocked_calls(calls: DataFrame, order: str, most: int = 2) -> DataFrame:
    """``blocked``: whether the same call has failed ``most`` times before in the run."""
    before = Window.partitionBy("run_id", "signature").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("blocked", F.coalesce(F.count_if(~F.col("ok")).over(before), F.lit(0)) >= most)


def routing_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query of ``found`` (query_id, doc_id) the share of ``gold`` (query_id, doc_id) that is found; 1 where there is no gold."""
    wanted = gold.groupBy("query_id").agg(F.count("doc_id").alias("__gold"))
    hits = found.distinct().join(gold.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("__hits"))
    joined = found.select("query_id").distinct().join(wanted, "query_id", "left").join(hits, "query_id", "left")
    share = F.try_divide(F.coalesce("__hits", F.lit(0)), F.col("__gold"))
    return joined.select("query_id", F.when(F.coalesce("__gold", F.lit(0)) == 0, 1.0).otherwise(share).alias("recall"))


def regressions(baseline: DataFrame, current: DataFrame, drop: float = 0.05, recall_floor: float = 0.80) -> DataFrame:
    """Per metric (metric, value): whether it fails: missing now, fallen by more than ``drop``, or a recall under its floor."""
    both = baseline.select("metric", F.col("value").alias("was")).join(current.select("metric", F.col("value").alias("now")), "metric", "full_outer")
    low = F.col("metric").contains("recall") & (F.col("now") < recall_floor)
    return both.withColumn("failed", F.col("now").isNull() | F.coalesce(F.col("was") - F.col("now") > drop, F.lit(False)) | F.coalesce(low, F.lit(False)))


def metric_means(scores: DataFrame) -> DataFrame:
    """Per metric: mean of the valid scores (4 decimals), and how many were null or not a number, which count for nothing."""
    valid = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy("metric").agg(F.round(F.avg(valid), 4).alias("mean"), F.count(valid).alias("valid"), F.count_if(valid.isNull()).alias("missing"))


def outcome(answer: Column, truth: Column, tolerance: float = 0.005) -> Column:
    """CORRECT within the relative tolerance, ABSTAINED without an answer, else WRONG."""
    return F.when(answer.isNull(), "ABSTAINED").when(F.abs(answer - truth) <= tolerance * F.abs(truth), "CORRECT").otherwise("WRONG")


def grid_status(cell: Column) -> Column:
    """Status of a review-grid cell struct (status, value, n_sources): found needs a source, else it abstains; unknown states are errors."""
    said = F.lower(F.coalesce(cell["status"], F.lit("")))
    return F.when((said == "found") & (F.coalesce(cell["n_sources"], F.lit(0)) == 0), "abstain").when(said.isin("found", "missing", "abstain", "error"), said).otherwise("error")


ENVELOPE = ("status", "value", "quote")
PARSED = StructType([StructField("formed", BooleanType()), StructField("leaves", StringType())])


@F.pandas_udf(PARSED)
def parsed(objects: pd.Series) -> pd.DataFrame:
    """Of each text that is one JSON object whether it has a key of an envelope, and if not, its distinct scalars as one text, in the
    order they stand, at most six levels deep; nulls for other texts."""

    def walk(x, depth: int) -> Iterator[str]:
        if isinstance(x, (dict, list)):
            for inner in (x.values() if isinstance(x, dict) else x) if depth < 6 else ():
                yield from walk(inner, depth + 1)
        elif x is not None and str(x).strip().lower() not in ("", "null"):
            yield str(x).strip()

    def told(text: str | None) -> tuple[bool | None, str | None]:
        try:
            found = json.loads(text or "")
        except (ValueError, RecursionError):
            return None, None
        if not isinstance(found, dict):
            return None, None
        formed = any(key in found for key in ENVELOPE)
        return formed, None if formed else "; ".join(dict.fromkeys(walk(found, 0))) or None

    return pd.DataFrame([told(x) for x in objects], columns=["formed", "leaves"], dtype=object)


def grid_cells(answers: DataFrame) -> DataFrame:
    """Answers (answer, n_sources, degraded) of a review grid with their cell: status, value, quote, risk, note and abstain_reason.

    An answer is a JSON object, fenced or among prose.  With a key of status, value or quote it is read as it stands: unknown states
    abstain, unknown risks are none, found without a source abstains for want of evidence, and what is missing is a risk.  An object of
    another shape counts as found by its scalars if it has a source and does not decline; other answers abstain as unparsed, those
    that decline as ambiguous.  A degraded run without an answer is an error.  Other columns pass through.
    """
    text = F.regexp_replace(F.trim(F.coalesce("answer", F.lit(""))), r"(?s)^```(?:json)?\s*(.*?)(?:```.*)?$", "$1")
    whole = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    read = answers.withColumn("__json", whole).withColumn("__parsed", parsed("__json"))
    leaves = F.col("__parsed.leaves")

    def part(name: str) -> Column:
        found = F.get_json_object("__json", f"$.{name}")
        return F.when(~found.isin("", "null"), found)

    grounded = F.coalesce("n_sources", F.lit(0)) > 0
    said, risk = F.lower(F.trim(part("status"))), F.lower(F.trim(part("risk")))
    said = F.when(said.isin("found", "missing", "abstain", "error"), said).otherwise("abstain")
    bare = (said == "found") & ~grounded
    status = F.when(bare, "abstain").otherwise(said)
    risk = F.when(risk.isin("standard", "non_standard", "missing"), risk).when(status == "missing", "missing").otherwise("none")
    note = F.when(bare, F.concat_ws(" | ", part("note"), F.lit("claimed found but no source span grounded it"))).otherwise(part("note"))
    why = F.when(bare, "no_evidence").when(status == "abstain", "ambiguous")
    none = F.lit(None).cast("string")
    cell = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("status", "value", "quote", "risk", "note", "abstain_reason"))))
    declined = F.rlike(F.lower(leaves), F.lit("^(?:" + "|".join(map(re.escape, P.DECLINES)) + ")"))
    unread = F.concat(F.lit("parse: "), F.coalesce(leaves, F.nullif(F.substring("answer", 1, 120), F.lit("")), F.lit("no parseable answer")))
    found = (
        F.when(F.coalesce("degraded", F.lit(False)) & (F.coalesce("answer", F.lit("")) == ""), cell(F.lit("error"), none, none, F.lit("none"), F.lit("the run degraded"), none))
        .when(F.col("__parsed.formed"), cell(status, F.when(~bare, part("value")), part("quote"), risk, note, why))
        .when(declined, cell(F.lit("abstain"), none, none, F.lit("none"), F.substring(leaves, 1, 200), F.lit("ambiguous")))
        .when(leaves.isNotNull() & grounded, cell(F.lit("found"), leaves, none, F.lit("none"), F.lit("parse: recovered from another shape"), none))
        .otherwise(cell(F.lit("abstain"), none, none, F.lit("none"), unread, F.lit("unparsed")))
    )
    return read.withColumn("__cell", found).select(*(answers[c] for c in answers.columns), "__cell.*")


REDLINE = "deviation boolean, quote string, rationale string, risk string"


def redline(findings: DataFrame) -> DataFrame:
    """Findings (topic, standard, raw JSON): unreadable ones and deviations without quote or rationale abstain."""
    f = F.from_json("raw", REDLINE)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    abstain = f.isNull() | f["deviation"].isNull() | (f["deviation"] & (blank(f["quote"]) | blank(f["rationale"])))
    status = F.when(abstain, "abstain").when(f["deviation"], "deviation").otherwise("standard")
    source = F.concat(F.col("topic"), F.lit(" → "), F.substring("standard", 1, 120))
    return findings.select("topic", status.alias("status"), F.coalesce(~blank(f["quote"]), F.lit(False)).alias("grounded"), source.alias("source_ref"))
