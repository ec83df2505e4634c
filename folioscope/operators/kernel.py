"""Table math on typed cells: parse, resolve or abstain, series, and a closed list of operations.

Cells are long: doc, table_id, row_ix, section, label, period, period_ix, raw.  No result is an exception: ``error`` says
why a value is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators.common import written
from folioscope.operators.scope import is_aggregate_request, is_lineitem

CELLS = "doc string, table_id string, row_ix int, section string, label string, period string, period_ix int, raw string"


def parse_cell(raw: Column) -> Column:
    """The number of a cell, null if it has none: a trailing % goes, then parentheses mean negative, then $ , % and spaces go."""
    bare = F.trim(raw)
    unmarked = F.when(bare.endswith("%"), F.trim(F.left(bare, F.length(bare) - 1))).otherwise(bare)
    wrapped = unmarked.rlike(r"^\(.*\)$")
    inner = F.when(wrapped, F.substr(unmarked, F.lit(2), F.length(unmarked) - 2)).otherwise(unmarked)
    digits = F.regexp_replace(inner, r"[,$%\s]", "")
    value = F.when(digits.rlike(r"^-?\d+(\.\d+)?$"), digits.try_cast("double"))
    missing = bare.isin("", "-", "—", "–", "n/a", "N/A", "NM")
    return F.when(~missing, F.when(wrapped, -value).otherwise(value))


def normal_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[\\[\\]\"'()`]", ""), r"\s+", " "))


def label_fit(label: Column, wanted: Column) -> Column:
    """2 if the normalised labels are equal, 1 if one holds the other, else 0."""
    a, b = normal_label(label), normal_label(wanted)
    return F.when(a == b, 2).when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), 1).otherwise(0)


def section_fits(section: Column, wanted: Column, lenient: bool = False) -> Column:
    """Without a wanted section every row fits.  ``lenient`` takes rows without a section as well."""
    a, b = normal_label(section), normal_label(wanted)
    held = a.contains(b) | b.contains(a)
    return (b == "") | (held if lenient else (a != "") & held)


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or nulls where there is none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def grams(text: Column, longest: int = 3) -> Column:
    """The distinct pieces of a text, of up to ``longest`` letters."""

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.filter(F.array_distinct(F.flatten(F.array(*map(pieces, range(1, longest + 1))))), lambda g: g != "")


def longest_grams(text: Column, longest: int = 3) -> Column:
    n = F.least(F.length(text), F.lit(longest))
    return F.filter(grams(text, longest), lambda g: F.length(g) == n)


def label_pairs(have: DataFrame, want: DataFrame) -> DataFrame:
    """(have, want, fit) of distinct normalised labels that fit each other: 2 if they are equal, 1 if one holds the other.

    An inverted index of pieces of letters: a label that is held by another has all its pieces there, so it looks only
    where its rarest one is, and only those labels are compared.
    """
    equal = have.select("have", F.col("have").alias("want"), F.lit(2).alias("fit")).join(want, "want", "left_semi").select("have", "want", "fit")

    def held(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        index = long.select(t, F.explode(grams(F.col(t))).alias("gram"))
        count = index.groupBy("gram").agg(F.count("*").alias("n"))
        asked = short.where(F.col(s) != "").select(s, F.explode(longest_grams(F.col(s))).alias("gram")).join(count, "gram")
        rarest = asked.groupBy(s).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        return rarest.join(index, "gram").where(F.col(t).contains(F.col(s)) & (F.col(t) != F.col(s))).select("have", "want", F.lit(1).alias("fit"))

    return equal.unionByName(held(want, "want", have, "have")).unionByName(held(have, "have", want, "want"))


def fitting_labels(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``label_pairs`` of the labels of cells and the wanted ones."""
    return label_pairs(cells.select(normal_label(F.col("label")).alias("have")).distinct(), asked.select(normal_label(F.col("want_label")).alias("want")).distinct())


def find_rows(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """For each ref (ref_id, want_section, want_label, want_period, and want_doc if it is scoped) and table: the cells of the
    best row, exact labels first, then the first row.  Refs meet cells by label and period, by way of ``label_pairs``."""
    asked = refs.select("ref_id", "want_section", "want_label", "want_period", optional(refs, "want_doc").alias("want_doc"))
    asked = asked.join(fitting_labels(cells, asked), normal_label(F.col("want_label")) == F.col("want"))
    hits = cells.join(asked, (normal_label(F.col("label")) == F.col("have")) & (F.col("period") == F.col("want_period"))).drop("have", "want")
    in_scope = F.col("want_doc").isNull() | (F.col("doc") == F.col("want_doc"))
    hits = hits.where(in_scope & section_fits(F.col("section"), F.col("want_section")))
    best = Window.partitionBy("ref_id", "doc", "table_id").orderBy(F.desc("fit"), "row_ix")
    return hits.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place").withColumn("value", parse_cell(F.col("raw")))


def value_cells(cells: DataFrame) -> DataFrame:
    """The cells of a table's period axis (``is_period``), or all cells of a table that has none."""
    any_period = F.bool_or(F.coalesce("is_period", F.lit(False))).over(Window.partitionBy("doc", "table_id"))
    return cells.withColumn("axis", any_period).where(F.coalesce("is_period", F.lit(False)) | ~F.col("axis")).drop("axis")


def with_value_kind(cells: DataFrame) -> DataFrame:
    """``value_kind`` of each row: percent if a cell has a % mark, or its section says so and no value is beyond 100; else currency."""
    row = Window.partitionBy("doc", "table_id", "row_ix")
    value = parse_cell(F.col("raw"))
    marked = F.coalesce(F.bool_or(F.col("raw").contains("%")).over(row), F.lit(False))
    small = F.max(F.abs(value)).over(row) <= 100
    said = F.coalesce(F.col("section"), F.lit("")).rlike(P.PERCENT_SECTION)
    return cells.withColumn("value_kind", F.when(marked | F.coalesce(said & small, F.lit(False)), "percent").otherwise("currency"))


def looks_like_total(cells: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """``is_total`` of each cell among the cells of its table and period: true if it is the sum of the others or the largest,
    false if clearly smaller than the largest, else null."""
    value = parse_cell(F.col("raw"))
    peers = Window.partitionBy("doc", "table_id", "period")
    valued = cells.withColumn("value", value)
    others = F.sum("value").over(peers) - F.col("value")
    largest = F.max(F.abs("value")).over(peers)
    n = F.count("value").over(peers)
    size = F.abs(F.col("value"))
    total = (
        F.when(F.col("value").isNull() | (n < 2), F.lit(None).cast("boolean"))
        .when((others != 0) & (F.abs(F.col("value") - others) <= tolerance * F.abs(others)), True)
        .when(size >= largest, True).when(size < largest * (1 - tolerance), False)
    )
    return valued.withColumn("is_total", total)


def total_consistency(cells: DataFrame) -> DataFrame:
    """``ok`` and ``decided`` of each cell that is used as a total: a component is not ok, and what nothing tells is ok but undecided."""
    told = looks_like_total(cells)
    return told.withColumn("ok", F.coalesce("is_total", F.lit(True))).withColumn("decided", F.col("is_total").isNotNull())


def resolve(candidates: DataFrame, refs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per ref of ``refs``: value and cells, or the error.

    Prose rows go, then components where an aggregate is asked for; per document exact labels beat contained ones and
    currency beats percent.  Different values (4 decimals) are ambiguous, the same value restated is not.  A ref without
    candidates was not found, or asks for a document that ``cells`` do not have.
    """
    doc = Window.partitionBy("ref_id", "doc")
    kept = candidates.where(F.col("value").isNotNull() & is_lineitem(F.col("label")))
    kept = kept.where(~(is_aggregate_request(F.col("want_label")) & F.coalesce(~F.col("is_total"), F.lit(False))))
    kept = kept.withColumn("best_fit", F.max("fit").over(doc)).where(F.col("fit") == F.col("best_fit"))
    money = (F.col("value_kind") == "currency").cast("int")
    kept = kept.withColumn("money", F.max(money).over(doc)).where(money == F.col("money"))
    per = kept.groupBy("ref_id").agg(
        F.countDistinct(F.round("value", 4)).alias("n_values"), F.min("value").alias("value"), F.count("*").alias("n_cells"),
        F.array_sort(F.collect_set(F.struct("doc", "table_id", "section", "label", "period", "raw"))).alias("cells"),
    )
    asked = refs.select("ref_id", optional(refs, "want_doc").alias("want_doc"))
    if cells is None:
        asked = asked.withColumn("known", F.lit(True))
    else:
        docs = cells.select(F.col("doc").alias("known_doc")).distinct()
        asked = asked.join(docs, F.col("want_doc") == F.col("known_doc"), "left").withColumn("known", F.col("want_doc").isNull() | F.col("known_doc").isNotNull())
    error = F.when(~F.col("known"), "document not in scope").when(F.col("n_values").isNull(), "cell not found").when(F.col("n_values") > 1, "ambiguous")
    found = asked.join(per, "ref_id", "left").withColumn("error", error)
    return found.select("ref_id", F.when(F.col("error").isNull(), F.col("value")).alias("value"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "cells", "error")


def period_year(period: Column) -> Column:
    full = F.nullif(F.regexp_extract(period, r"((?:19|20)\d{2})", 1), F.lit(""))
    short = F.nullif(F.regexp_extract(period, r"(?i)FY\s?'?(\d{2})\b", 1), F.lit(""))
    two = F.try_to_number(short, F.lit("99")).cast("int")
    return F.coalesce(F.try_to_number(full, F.lit("9999")).cast("int"), F.when(two < 70, two + 2000).otherwise(two + 1900))


def result(op: str, value: Column, unit: str, error: Column) -> list[Column]:
    """value where there is no error, and the error."""
    failed = F.coalesce(error, F.when(value.isNull(), "cell not found"))
    return [F.lit(op).alias("op"), F.when(failed.isNull(), value).alias("value"), F.lit(unit).alias("unit"), failed.alias("error")]


def delta(a: Column, b: Column) -> list[Column]:
    return result("delta", b - a, "", F.lit(None).cast("string"))


def growth_pct(a: Column, b: Column) -> list[Column]:
    return result("growth_pct", F.try_divide(b - a, F.abs(a)) * 100, "%", F.when(a == 0, "base is zero"))


def difference(a: Column, b: Column, error: Column | None = None) -> list[Column]:
    return result("difference", a - b, "", F.lit(None).cast("string") if error is None else error)


def combined(operands: DataFrame, op: str) -> DataFrame:
    """Per spec (spec_id, ref_id, value, error) the sum or average of its referenced cells; any cell without a value is an error,
    the first by ref_id."""
    missing = F.when(F.col("value").isNull(), F.coalesce("error", F.lit("cell not found")))
    value = F.sum("value") if op == "sum" else F.avg("value")
    per = operands.groupBy("spec_id").agg(value.alias("total"), F.count("*").alias("n_operands"), F.min(F.when(missing.isNotNull(), F.struct("ref_id", missing.alias("why")))).alias("first"))
    return per.select("spec_id", "n_operands", *result(op, F.col("total"), "", F.col("first.why")))


def ratio(num: Column, den: Column, num_section: Column, den_section: Column, percent: bool = False, num_cell: Column | None = None, den_cell: Column | None = None) -> list[Column]:
    """Error if the denominator is 0, both are one cell, or the two come from different sections."""
    section = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    apart = (section(num_section) != "") & (section(den_section) != "") & (section(num_section) != section(den_section))
    error = F.when(den == 0, "denominator is zero")
    if num_cell is not None and den_cell is not None:
        error = error.when(num_cell == den_cell, "same cell")
    return result("margin_pct" if percent else "ratio", F.try_divide(num, den) * (100 if percent else 1), "%" if percent else "x", error.when(apart, "different sections"))


def provenance(op: str, cells: Column, value: Column, threshold: float | None = None) -> Column:
    """What an answer may state: the cells read (an array of structs with label, period and raw), the threshold, the result and
    its rounding to one decimal where that differs."""
    entry = lambda kind, label, v: F.struct(F.lit(kind).alias("kind"), label.alias("label"), v.cast("double").alias("value"))
    read = F.transform(F.coalesce(cells, F.array()), lambda c: entry("cell", F.concat_ws(" ", c["label"], c["period"]), parse_cell(c["raw"])))
    params = [] if threshold is None else [entry("param", F.lit("threshold"), F.lit(threshold))]
    rounded = F.when(F.round(value, 1) != value, entry("param", F.lit("result_rounded"), F.round(value, 1)))
    extra = F.array(*params, F.when(value.isNotNull(), entry("param", F.lit("result"), value)), rounded)
    return F.concat(read, F.filter(extra, lambda e: e.isNotNull()))


def entity_series(resolved: DataFrame) -> DataFrame:
    """(series_id, key, value, series_ix, error) over line items of one period (series_id, ix, section, label, value): the key is
    the section, or the label without one; items without a value drop out, and a series with none left is an error."""
    key = F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.nullif(F.trim("label"), F.lit("")), F.lit("?"))
    kept = resolved.where("value is not null").select("series_id", key.alias("key"), "value", F.row_number().over(Window.partitionBy("series_id").orderBy("ix")).alias("series_ix"))
    joined = resolved.select("series_id").distinct().join(kept, "series_id", "left")
    return joined.withColumn("error", F.when(F.col("series_ix").isNull(), "no numeric cells"))


def period_series(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """(series_id, key, value, error): each asked line item (series_id, want_section, want_label) over the periods of the tables
    that hold it.

    Tables with real years come first, the wanted section before any section; line items beat prose; within a document exact
    labels beat contained ones and currency beats percent.  One document gives its first table, several are joined as by
    ``union_series``.
    """
    wanted = asked.join(fitting_labels(cells, asked), normal_label(F.col("want_label")) == F.col("want"))
    labels = cells.select("label").distinct().join(wanted, normal_label(F.col("label")) == F.col("have")).drop("have", "want", "fit")
    known = value_cells(cells) if "is_period" in cells.columns else cells
    known = with_value_kind(known).withColumn("year", period_year(F.col("period")))
    known = known.withColumn("dated", F.count("year").over(Window.partitionBy("doc", "table_id")) > 0)
    hits = known.join(labels, "label").withColumn("fit", label_fit(F.col("label"), F.col("want_label")))
    sectioned = section_fits(F.col("section"), F.col("want_section"))
    hits = hits.withColumn("choice", F.when(F.col("dated") & sectioned, 1).when(F.col("dated"), 2).when(sectioned, 3).otherwise(4))
    in_series = Window.partitionBy("series_id")
    hits = hits.withColumn("best_choice", F.min("choice").over(in_series)).where(F.col("choice") == F.col("best_choice"))
    row = Window.partitionBy("series_id", "doc", "table_id").orderBy(F.desc("fit"), "row_ix")
    hits = hits.withColumn("place", F.dense_rank().over(row)).where("place = 1").withColumn("item", is_lineitem(F.col("label")))
    hits = hits.withColumn("items", F.bool_or("item").over(in_series)).where("item or not items")
    in_doc = Window.partitionBy("series_id", "doc")
    hits = hits.withColumn("best_fit", F.max("fit").over(in_doc)).where(F.col("fit") == F.col("best_fit"))
    money = (F.col("value_kind") == "currency").cast("int")
    hits = hits.withColumn("money", F.max(money).over(in_doc)).where(money == F.col("money")).withColumn("value", parse_cell(F.col("raw")))
    hits = hits.withColumn("docs", F.size(F.collect_set("doc").over(in_series)))
    first = F.dense_rank().over(in_series.orderBy("doc", "table_id"))
    single = hits.where("docs < 2").withColumn("host", first).where("host = 1 and value is not null").select("series_id", F.col("period").alias("key"), "value", F.lit(None).cast("string").alias("error"))
    several = union_series(hits.where("docs > 1 and year is not null and value is not null").select("series_id", "doc", F.col("year").cast("string").alias("key"), "value"))
    found = single.unionByName(several)
    return asked.select("series_id").distinct().join(found, "series_id", "left").withColumn("error", F.when(F.col("key").isNull(), "row not found").otherwise(F.col("error")))


def ordered_series(points: DataFrame) -> DataFrame:
    """(series_id, key, value, series_ix): by year where every key of the series has one, else in the order given (``ix``)."""
    years = points.withColumn("__year", period_year(F.col("key")))
    whole = Window.partitionBy("series_id")
    all_years = F.count("__year").over(whole) == F.count("*").over(whole)
    sort_key = F.when(F.col("__all"), F.col("__year")).otherwise(F.col("ix"))
    return years.withColumn("__all", all_years).withColumn("series_ix", F.row_number().over(Window.partitionBy("series_id").orderBy(sort_key, "ix"))).drop("__year", "__all", "ix")


def cagr(series: DataFrame) -> DataFrame:
    """Compound rate from the first to the last point; the exponent is the number of points less one."""
    per = series.groupBy("series_id").agg(
        F.count("*").alias("n"), F.min_by("value", "series_ix").alias("begin"), F.max_by("value", "series_ix").alias("end")
    )  # series_ix is unique in a series
    rate = (F.pow(F.col("end") / F.col("begin"), 1.0 / (F.col("n") - 1)) - 1) * 100
    error = F.when(F.col("n") < 2, "fewer than two cells").when(F.col("begin") <= 0, "begin is not positive")
    return per.select("series_id", *result("cagr_pct", F.when(error.isNull(), rate), "%", error))


def extreme(series: DataFrame, largest: bool) -> DataFrame:
    """The largest or smallest point of each series; the first of equals, never one without a value."""
    order = Window.partitionBy("series_id").orderBy(F.desc("value") if largest else F.asc("value"), "series_ix")
    best = series.where("value is not null").withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.select("series_id", F.col("key").alias("binding"), "value")


def crossing(series: DataFrame, threshold: float, first_exceeds: bool) -> DataFrame:
    """The first point above, or the last below, the threshold (strictly), with the number of points; no hit is an error."""
    hit = (F.col("value") > threshold) if first_exceeds else (F.col("value") < threshold)
    place = F.when(hit, F.col("series_ix") * (1 if first_exceeds else -1))
    per = series.groupBy("series_id").agg(F.count("*").alias("candidates"), F.min(place).alias("__at"), F.min_by(F.when(hit, F.col("key")), place).alias("binding"), F.min_by(F.when(hit, F.col("value")), place).alias("value"))
    return per.select("series_id", "candidates", "binding", "value", F.when(F.col("__at").isNull(), "no period qualifies").alias("error"))


def ranked(series: DataFrame, top: int, descending: bool = True) -> DataFrame:
    """The ``top`` points of each series that have a value."""
    order = Window.partitionBy("series_id").orderBy(F.desc("value") if descending else F.asc("value"), "series_ix")
    return series.where("value is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


COMPARE = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def filtered(series: DataFrame, op: str, threshold: float) -> DataFrame:
    """The keys that pass, joined in series order; none is an error."""
    passing = F.when(COMPARE[op](F.col("value"), F.lit(threshold)), F.struct("series_ix", "key"))
    per = series.groupBy("series_id").agg(F.array_sort(F.collect_list(passing)).alias("hits"))
    return per.select("series_id", F.size("hits").cast("long").alias("n_hits"), F.array_join(F.transform("hits", lambda h: h["key"]), ", ").alias("binding"), F.when(F.size("hits") == 0, "nothing passes").alias("error"))


def union_series(points: DataFrame) -> DataFrame:
    """One series from several documents (series_id, doc, key, value): allowed if a year is shared and shared years agree.

    Rows: series_id, key, value; error where the documents can't be joined.
    """
    per = points.groupBy("series_id", "key").agg(F.countDistinct(F.round("value", 4)).alias("__values"), F.countDistinct("doc").alias("__docs"), F.min("value").alias("value"))
    whole = Window.partitionBy("series_id")
    error = F.when(F.max("__values").over(whole) > 1, "documents disagree").when(F.max("__docs").over(whole) < 2, "no shared year")
    return per.select("series_id", "key", F.when(error.isNull(), F.col("value")).alias("value"), error.alias("error"))


def label_score(label: Column, wanted: Column) -> Column:
    """1 for equal labels, 0.8 if one holds the other, else 0.6 times the share of wanted words found."""
    words = lambda c: F.array_distinct(F.split(normal_label(c), " "))
    overlap = F.try_divide(F.size(F.array_intersect(words(label), words(wanted))), F.size(words(wanted)))
    fit = label_fit(label, wanted)
    return F.when(fit == 2, 1.0).when(fit == 1, 0.8).otherwise(0.6 * F.coalesce(overlap, F.lit(0.0)))


def scored_cells(cells: DataFrame, metrics: DataFrame, most: int = 5) -> DataFrame:
    """Cells of each metric's period (metric_id, want_label, want_period) with their score: the label's, +0.15 for a proven total
    where one is wanted, times 0.85 where it is unproven or a component.

    Cells meet metrics by period and label, of labels that fit or share a word.  Cells whose label has nothing in common
    with the wanted one all score alike, so only the first 2 ``most`` totals and others of each period are there, which are
    enough to fill a list of ``most``.
    """
    known = looks_like_total(with_value_kind(cells)).where(F.col("value").isNotNull()).withColumn("have", normal_label(F.col("label")))
    asked = metrics.withColumn("want", normal_label(F.col("want_label")))
    words = lambda df, c: df.select(c).distinct().select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("word")).where("word <> ''")
    alike = words(known, "have").join(words(asked, "want"), "word").select("have", "want").distinct()
    near = alike.unionByName(fitting_labels(known, asked).select("have", "want")).distinct()
    by_label = known.join(asked.join(near, "want"), ["have"]).where(F.col("period") == F.col("want_period"))
    first = F.row_number().over(Window.partitionBy("period", F.coalesce("is_total", F.lit(False))).orderBy("doc", "table_id", "row_ix"))
    few = known.withColumn("place", first).where(F.col("place") <= 2 * most).drop("place")
    rest = few.join(asked, F.col("period") == F.col("want_period")).join(near, ["have", "want"], "left_anti")
    met = by_label.unionByName(rest).drop("have", "want")
    wants_total = is_aggregate_request(F.col("want_label"))
    base = label_score(F.col("label"), F.col("want_label"))
    weighed = F.when(wants_total & F.coalesce(F.col("is_total"), F.lit(False)), base + 0.15).when(wants_total, base * 0.85).otherwise(base)
    return met.withColumn("score", weighed).withColumn("wants_total", wants_total)


def ground(cells: DataFrame, metrics: DataFrame, floor: float = 0.55, near: float = 0.08, scored: DataFrame | None = None) -> DataFrame:
    """One row per metric (metric_id, want_label, want_period): the cell, or why not.  ``scored``: what ``scored_cells`` gave already.

    Another value within ``near`` of the best abstains, except that a wanted total takes the largest of the tied; a metric
    whose period has no cell abstains without a score.
    """
    scored = scored_cells(cells, metrics) if scored is None else scored
    top = scored.groupBy("metric_id").agg(F.max("score").alias("top"))
    per = scored.join(top, "metric_id").where(F.col("score") >= F.col("top") - near).groupBy("metric_id").agg(
        F.max("top").alias("score"), F.countDistinct(F.round("value", 4)).alias("n_values"), F.bool_or("wants_total").alias("wants_total"),
        F.max_by("value", F.abs("value")).alias("largest"), F.min("value").alias("value"),
    )
    found = F.when(F.col("n_values") == 1, F.col("value")).when(F.col("wants_total"), F.col("largest"))
    status = F.when(F.col("score").isNull() | (F.col("score") < floor), "abstain").when(found.isNull(), "ambiguous").otherwise("ok")
    whole = metrics.select("metric_id").join(per, "metric_id", "left")
    return whole.select("metric_id", status.alias("status"), F.when(status == "ok", found).alias("value"), F.round("score", 6).alias("score"))


def lookup(cells: DataFrame, metrics: DataFrame, most: int = 5, **options) -> DataFrame:
    """``ground`` with the ``most`` best cells of each metric as candidates, best first: an answer or an abstention is always a row."""
    best = Window.partitionBy("metric_id").orderBy(F.desc("score"), "doc", "table_id", "row_ix")
    scored = written(scored_cells(cells, metrics, most), "scored")
    ranked_cells = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    told = F.struct("place", F.round("score", 6).alias("score"), "doc", "table_id", "label", "period", "raw")
    candidates = ranked_cells.groupBy("metric_id").agg(F.array_sort(F.collect_list(told)).alias("candidates"))  # ``most`` each
    return ground(cells, metrics, scored=scored, **options).join(candidates, "metric_id", "left")


def display(value: Column, unit: Column) -> Column:
    """Percentages with one decimal, multiples with two, other values with separators."""
    return F.when(unit == "%", F.concat(F.format_number(value, 1), F.lit("%"))).when(unit == "x", F.concat(F.format_number(value, 2), F.lit("x"))).otherwise(F.format_number(value, 0))


def close_labels(labels: DataFrame, wanted: DataFrame, most: int = 3, cutoff: float = 0.5) -> DataFrame:
    """(want, label, likeness): the ``most`` closest labels, likeness being 1 - edit distance / longer length.

    A sequence matcher's ratio would rate shared blocks; edit distance is what Spark has.  Labels that are alike share
    ``cutoff`` of the longer one's letters, each as often as both have it, so whatever is alike to a label holds one of its first
    letters in any fixed order: all but that share, and one more.  Labels meet by those, the rarest first, and by length.
    """
    # a letter with its number among equal ones, so that letters are a set
    letters = F.expr("transform(split(text, ''), (c, i) -> concat(c, cast(size(filter(split(text, ''), (d, j) -> j <= i and d = c)) as string)))")
    have = labels.select("label").distinct().withColumn("text", normal_label(F.col("label"))).withColumn("letter", F.explode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(letters)))
    want = wanted.select("want").distinct().withColumn("text", normal_label(F.col("want"))).withColumn("letter", F.explode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(letters)))
    rarity = have.groupBy("letter").agg(F.count("*").alias("n"))

    def first(rows: DataFrame, key: str) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "letter"))
        size = F.greatest(F.length("text"), F.lit(1))
        return rows.join(rarity, "letter", "left").withColumn("place", order).where(F.col("place") <= size - F.ceil(size * cutoff) + 1).select(key, F.col("text").alias(f"{key}_text"), "letter")

    a, b = F.col("label_text"), F.col("want_text")
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    near_size = F.least(F.length(a), F.length(b)) >= cutoff * F.greatest(F.length(a), F.length(b))
    met = first(have, "label").join(first(want, "want"), "letter").where(near_size).drop("letter").distinct()
    near = met.withColumn("likeness", 1 - F.levenshtein(a, b) / longer).where(F.col("likeness") >= cutoff).select("label", "want", "likeness")
    best = Window.partitionBy("want").orderBy(F.desc("likeness"), "label")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def wide(cells: DataFrame, periods: list[str]) -> DataFrame:
    """Rows by label with one column per period, for export."""
    return cells.groupBy("doc", "table_id", "row_ix", "section", "label").pivot("period", periods).agg(F.first("raw"))
