"""Mixing sources to target weights.

Sizes (words) are summed per source; targets come from weights and a word budget, with no target above ``cap`` times its
source's size and the excess shared again by weight.  A source's repetition rate is target / size; each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction, so reruns agree
and no row order matters.

Defined results: null texts have size 0; null sources are one source that sorts last; sources of size 0 have target and
rate 0; repeated rows draw the same coin as they have the same id; very long texts are counted whole; an empty table gives
no rows; other columns, whatever their names, pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import column, join_small, scratch, whole_row

#: A word, by ASCII white space; weights of the sources in code point order, repeating; the budget as a
#: share of all words; the most that a target may be, as a multiple of its source's size.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0


def n_words(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def coin(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of seed and columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row per source: source_size, target, rate.

    With the sources in order of cap / weight, the common level of those below their cap is the largest of
    (budget - caps before) / (weights from here on); windows run over one row per source.
    """
    per = sizes.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("source_size"))
    ranked = per.withColumn("n", F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    here = Window.orderBy(F.col("most") / F.col("w"), F.col("n"))
    whole = Window.partitionBy()
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("most"), F.col("w") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return leveled.select(F.col("s").alias(source), "source_size", target.alias("target"), rate.alias("rate"))


def planned(rows: DataFrame, seed: int = 17, **targets) -> DataFrame:
    """Rows of (row, id, source, size), read once for the sums by source and once for the plan, with source_size, target, rate
    and copies (how often the row is emitted)."""
    rates = source_targets(rows, "source", "size", **targets).select("source", F.struct("source_size", "target", "rate").alias("found"))
    rate = F.col("found.rate")
    copies = F.floor(rate) + (coin(seed, F.col("id")) < rate - F.floor(rate)).cast("long")
    return join_small(rows, rates, "source").select("row", "size", "found.*", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as its copies say, with the columns of ``docs``.

    Sizes are needed for the sums alone; the second reading takes the rows as they are.
    """
    rows = docs.select(whole_row(docs), column(id_col).alias("id"), column(source_col).alias("source"), n_words(column(text_col)).alias("size"))
    emitted = planned(rows, **options).where("copies > 0")
    return emitted.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes); sizes are counted once and written."""
    sizes = scratch(docs.select(F.struct("doc_id").alias("row"), F.col("doc_id").alias("id"), "source", n_words("text").alias("size")), "sizes")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned(sizes, **options).select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken)


ORACLE = f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) - 1 as n, source_size * {CAP} as cap from per),
weighed as (select *, [{', '.join(f'{float(w)}' for w in WEIGHTS)}][(n % {len(WEIGHTS)} + 1)::int]::double as w from ranked),
leveled as (select *, (sum(source_size) over () * {BUDGET} - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from weighed window before as (order by cap / w, n rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, least(cap, w * max(level) over ()) as target from leveled),
rates as (select *, case when source_size > 0 then target / source_size else 0 end as rate from targets)
select doc_id, size, source_size, round(target::double, 6) as target,
  (size * (floor(rate) + case when ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint / {2**48}::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized s join rates r on s.source is not distinct from r.source
"""
