"""Scopes, filters and question predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import patterns as P


@dataclass(frozen=True)
class Scope:
    """What may be searched.  Of the scope keys the first that is given counts; an empty list means nothing, None no scope."""

    doc_id: object = None
    doc_ids: list | None = None
    collection_id: object = None
    filenames: list | None = None
    filename: str | None = None
    page: int | None = None
    chunk_type: str | None = None
    metadata: dict = field(default_factory=dict)

    KEYS = ("doc_id", "collection_id", "filename", "page_number", "chunk_type")

    def predicate(self) -> Column:
        col, always = F.col, F.lit(True)
        within = lambda c, xs: col(c).isin(*xs) if xs else F.lit(False)
        if self.doc_id is not None:
            base = col("doc_id") == self.doc_id
        elif self.doc_ids is not None:
            base = within("doc_id", self.doc_ids)
        elif self.collection_id is not None:
            base = col("collection_id") == self.collection_id
        elif self.filenames is not None:
            base = within("filename", self.filenames)
        else:
            base = col("filename") == self.filename if self.filename is not None else always
        parts = [base]
        if self.page is not None:
            parts.append(col("page_number") == self.page)
        if self.chunk_type is not None:
            parts.append(col("chunk_type") == self.chunk_type)
        parts += [equals(k, v) for k, v in self.metadata.items() if k not in self.KEYS]  # narrowing never overwrites the scope
        return reduce(lambda a, b: a & b, parts)


def equals(column: str, condition) -> Column:
    """A scalar, or {"$in": [...]}."""
    wanted = condition["$in"] if isinstance(condition, dict) else [condition]
    return F.col(column).isin(*wanted) if wanted else F.lit(False)


def null_safe(conditions: dict) -> Column:
    """Unknown values never exclude a row."""
    return reduce(lambda a, b: a & b, (F.col(k).isNull() | equals(k, v) for k, v in conditions.items()), F.lit(True))


def narrowed(docs: DataFrame, conditions: dict, least_docs: int = 20) -> DataFrame:
    """The rows that pass the null-safe filter; all rows, if there are ``least_docs`` at most or none passes."""
    counted = docs.agg(F.count("*").alias("__n"), F.count_if(null_safe(conditions)).alias("__hits"))
    use = (F.col("__n") > least_docs) & (F.col("__hits") > 0)
    return docs.join(F.broadcast(counted)).where(~use | null_safe(conditions)).drop("__n", "__hits")  # one row of counts


def same_document(a: Column, b: Column) -> Column:
    """One normalised name holds the other; empty names match nothing."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "")
    return (bare(a) != "") & (bare(b) != "") & (bare(a).contains(bare(b)) | bare(b).contains(bare(a)))


def is_lineitem(label: Column, most_words: int = 6) -> Column:
    bare = F.trim(F.coalesce(label, F.lit("")))
    sentence = bare.endswith(".") & ~bare.endswith("..")
    return (bare != "") & (F.size(F.split(bare, r"\s+")) <= most_words) & ~bare.contains(",") & ~sentence


def is_aggregate_request(label: Column) -> Column:
    return F.coalesce(label, F.lit("")).rlike(P.AGGREGATE_LABEL)


def has_numeric_intent(question: Column) -> Column:
    text = F.coalesce(question, F.lit(""))
    return text.rlike(P.NUMERIC_CUES) | text.rlike(P.HAS_NUMBER)


def neutralised(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", "[FILTERED]"), P.INJECTIONS, text)


def complexity(question: Column) -> Column:
    """simple, moderate or complex."""
    text = F.trim(F.lower(question))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    hard = reduce(lambda a, b: a | b, (text.rlike(p) for p in P.COMPLEX))
    simple = text.rlike(P.PAGE_REFERENCE) | (words <= 6) | text.rlike(P.LOOKUP_OPENER)
    return F.when(simple, "simple").when(hard | (words > 25), "complex").otherwise("moderate")


def in_pages(page: Column, pages: str | None) -> Column:
    """Pages "a-b" or "n"; pages that are no numbers are in no range."""
    if not pages:
        return F.lit(True)
    low, _, high = pages.partition("-")
    return F.coalesce(page.try_cast("int").between(int(low), int(high or low)), F.lit(False))


def page_rows(rows: DataFrame, pages: str | None, most: int = 64) -> DataFrame:
    """Rows of a page range, all rows where none is in it, ``most`` by order of doc_id and page."""
    hits = rows.agg(F.count_if(in_pages(F.col("page_number"), pages)).alias("__hits"))
    kept = rows.join(F.broadcast(hits)).where((F.col("__hits") == 0) | in_pages(F.col("page_number"), pages)).drop("__hits")
    return kept.orderBy("doc_id", "page_number").limit(most)


def foreign_spans(ledger: DataFrame, active) -> Column:
    return (F.col("kind") == "span") & F.col("collection_id").isNotNull() & (F.col("collection_id") != F.lit(active))


def unsignable(title: Column, declared: Column) -> Column:
    """The excluded instrument that is declared, else that the title speaks of; null if it may be signed."""
    kind = F.replace(F.lower(F.trim(F.coalesce(declared, F.lit("")))), F.lit(" "), F.lit("_"))
    known = sorted({k for _, k in P.UNSIGNABLE})
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(declared, F.lit(""))))
    by_title = F.coalesce(*(F.when(hay.rlike(p), k) for p, k in P.UNSIGNABLE))
    return F.when(kind.isin(*known), kind).otherwise(by_title)


def of_instruments(found: DataFrame, allowed: list[str] | None) -> DataFrame:
    """What was found in instruments of the allowed types, whatever its score; no list allows all, an empty one nothing."""
    return found if allowed is None else found.where(F.coalesce(F.lower(F.trim("instrument_type")).isin(*[a.strip().lower() for a in allowed]), F.lit(False)))
