"""Folds that split a document's rows in order: clauses of elements, provisions of statutes' lines, title chunks.

A document passes row by row, and a task holds a batch of rows and the open chunk, however long the document is.  ``folded`` is for
tables: one shuffle, and Arrow batches that hold rows of many documents.  The table functions are for SQL, where each names its own
partitioning, order and columns, so that ``select * from split_clauses(table(elements))`` is enough; they pay a call for each row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from folioscope.functions import patterns as P


class ClauseFold:
    """Clause chunks (chunk_index, heading, page_number, text) of one document, whose elements are given in order.

    A heading starts a chunk if the open one has at least ``start_chars``; a chunk is closed once it has ``max_chars``;
    chunks under ``least_chars`` go.  A chunk's page is that of its first element (``compat_page``: the document's).
    Elements that are null or blank are passed over.
    """

    def __init__(self, max_chars: int = 3000, start_chars: int = 40, least_chars: int = 10, compat_page: bool = False):
        self.max_chars, self.start_chars, self.least_chars, self.compat_page = max_chars, start_chars, least_chars, compat_page
        self.is_heading = re.compile(P.HEADING).match
        self.n, self.first_page = 0, None
        self.open()

    def open(self) -> None:
        self.parts, self.heading, self.page, self.size = [], None, None, 0

    def end(self) -> Iterator[tuple]:
        text = "\n".join(self.parts).strip()
        if len(text) >= self.least_chars:
            self.n += 1
            yield self.n, self.heading, self.first_page if self.compat_page else self.page, text
        self.open()

    def take(self, raw: str | None, page: int | None) -> Iterator[tuple]:
        text = (raw or "").strip()
        if not text:
            return
        marked = self.is_heading(raw)
        if marked and self.size >= self.start_chars:
            yield from self.end()
        if marked and self.heading is None:
            self.heading = text[:120]
        self.first_page = page if self.first_page is None else self.first_page
        self.page = page if self.page is None else self.page
        self.parts.append(text)
        self.size += len(text) + 1
        if self.size >= self.max_chars:
            yield from self.end()


CHAPTER = re.compile(r"^(CHAPTER|PART)\s+([IVXLC\d]+[A-Z]?)\b[\s.:—–-]*(.*)$", re.IGNORECASE)
SCHEDULE = re.compile(r"^(?:THE\s+)?((?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)\s+)?SCHEDULE\b", re.IGNORECASE)
OPENER = re.compile(r"^(?:\d{1,3}\[)?\s*(\d{1,3}[A-Z]{0,2})\.\s*(\S.*)$")
BURIED = re.compile(r"(?:^|\s)\d{1,3}\[(\d{1,3}[A-Z]{0,2})\.\s+(\S.*)$")
FOOTNOTE = re.compile(r"^\d{1,3}\.\s+(?:Subs|Ins|Omitted|Rep|The words|Added)\b", re.IGNORECASE)
REPEALED = re.compile(r"^\[?\s*(?:Repealed|Omitted)\b", re.IGNORECASE)
TITLE = re.compile(r"^(.*?)(\s*\.?\s*[—–]\s*|\.\s+|\.?$)(.*)$")


class StatuteFold:
    """Provisions (ix, chapter, section_id, title, text, repealed) of one source, whose lines are given in order.

    Chapters and parts scope what follows, a schedule ends the sections, footnotes are left out, and sections open at
    "16. Title" or buried in a line as "1[16. Title".  With a table of contents only its ids open sections.  Repealed
    stubs are marked; of repeated ids the first stays.
    """

    def __init__(self, allowed: set[str] | None = None):
        self.allowed, self.chapter, self.current, self.parts = allowed, "", None, []
        self.n, self.seen, self.ended = 0, set(), False

    def end(self) -> Iterator[tuple]:
        if self.current is not None and self.current[1] not in self.seen:
            chapter, section, title, stub = self.current
            self.n += 1
            self.seen.add(section)
            yield self.n, chapter, section, title, " ".join(filter(None, self.parts)), stub
        self.current, self.parts = None, []

    def take(self, raw: str | None) -> Iterator[tuple]:
        line = "" if self.ended else " ".join((raw or "").split())
        if not line or FOOTNOTE.match(line):
            return
        if SCHEDULE.match(line) and self.current is not None:
            self.ended = True
            return
        if found := CHAPTER.match(line):
            self.chapter = f"{found[1].upper()} {found[2].upper()}"
            return
        opened, before = OPENER.match(line), ""
        if opened is None and "[" in line and (opened := BURIED.search(line)):
            before = line[: opened.start()].strip()
        if opened and (self.allowed is None or opened[1] in self.allowed):
            self.parts.append(before)
            yield from self.end()
            rest = opened[2].rstrip("]") if opened[2].endswith("]") and "[" not in opened[2] else opened[2]
            title, _, body = TITLE.match(rest).groups()
            self.current = (self.chapter, opened[1], title.strip("[] ."), bool(REPEALED.match(title) or REPEALED.match(body)))
            self.parts = [body.strip() or rest]
        elif self.current is not None:
            self.parts.append(line)


class TitleFold:
    """Title chunks (chunk_index, text) of one document, whose elements are given in order: a title starts a chunk unless the open
    one is under ``combine_under`` characters; a chunk takes no more once it has ``new_after`` and never grows over ``most``;
    longer elements are cut there."""

    def __init__(self, most: int = 3000, new_after: int = 2400, combine_under: int = 500):
        self.most, self.new_after, self.combine_under = most, new_after, combine_under
        self.n, self.text = 0, ""

    def end(self) -> Iterator[tuple]:
        if self.text:
            self.n += 1
            yield self.n, self.text
        self.text = ""

    def take(self, raw: str | None, category: str | None) -> Iterator[tuple]:
        text = raw or ""
        for piece in [text[i : i + self.most] for i in range(0, len(text), self.most)]:
            full = len(self.text) >= self.new_after or len(self.text) + len(piece) + 2 > self.most
            if self.text and (full or (category == "Title" and len(self.text) >= self.combine_under)):
                yield from self.end()
            self.text = f"{self.text}\n\n{piece}" if self.text else piece


#: Columns that follow the key.
CLAUSE = [("chunk_index", IntegerType()), ("heading", StringType()), ("page_number", IntegerType()), ("text", StringType())]
PROVISION = [("ix", IntegerType()), *((c, StringType()) for c in ("chapter", "section_id", "title", "text")), ("repealed", BooleanType())]
TITLED = [("chunk_index", IntegerType()), ("text", StringType())]


def folded(rows: DataFrame, key: str, columns: list[str], out: list[tuple], start: Callable, first: tuple[str, ...] = ()) -> DataFrame:
    """What a fold makes of each key's rows, in the order of ``elem_ix``: the key in its own type, then ``out``.

    ``start`` gets the values of ``first`` in the key's first row and returns the fold, which takes the ``columns``.  A key's rows may
    go on in the next batch.
    """
    schema = StructType([StructField(key, rows.schema[key].dataType), *(StructField(n, t) for n, t in out)])
    arrow = to_arrow_schema(schema)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [()] * len(arrow), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            done = []
            for i, (k, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, *columns)))):
                if fold is None or k != now:
                    done += [(now, *x) for x in fold.end()] if fold else []
                    now, fold = k, start(*(batch.column(c)[i].as_py() for c in first))
                done += [(k, *x) for x in fold.take(*row)]
            yield batch_of(done)
        if fold is not None:
            yield batch_of([(now, *x) for x in fold.end()])

    return rows.select(key, "elem_ix", *columns, *first).repartition(key).sortWithinPartitions(key, "elem_ix").mapInArrow(run, schema)


def shaped(table: AnalyzeArgument, key: str, others: list[str], out: list[tuple]) -> AnalyzeResult:
    """One partition for each ``key`` in the order of ``elem_ix``, of these columns only; the rows begin with the key in its own type."""
    if not table.isTable:
        raise ValueError("give the rows as a table argument: table(...)")
    fields = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in [key, "elem_ix", *others] if c not in fields]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    schema = StructType([StructField(key, fields[key]), *(StructField(n, t) for n, t in out)])
    select = [SelectedColumn(c) for c in [key, "elem_ix", *others]]
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn("elem_ix")], select=select)


@F.udtf(useArrow=False)
class SplitClauses:
    """``ClauseFold`` of each document: doc_id, chunk_index, heading, page_number, text; table: doc_id, elem_ix, page_number, text."""

    def __init__(self):
        self.fold = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, max_chars=None, start_chars=None, least_chars=None, compat_page=None) -> AnalyzeResult:
        return shaped(rows, "doc_id", ["page_number", "text"], CLAUSE)

    def eval(self, row: Row, max_chars=3000, start_chars=40, least_chars=10, compat_page=False):
        if self.fold is None:
            self.key, self.fold = row["doc_id"], ClauseFold(max_chars, start_chars, least_chars, compat_page)
        for chunk in self.fold.take(row["text"], row["page_number"]):
            yield self.key, *chunk

    def terminate(self):
        if self.fold is not None:
            for chunk in self.fold.end():
                yield self.key, *chunk


@F.udtf(useArrow=False)
class SplitStatutes:
    """``StatuteFold`` of each source: source_key, ix, chapter, section_id, title, text, repealed; table: source_key, elem_ix, text,
    toc_ids (array, null without a table of contents; that of the source's first line counts)."""

    def __init__(self):
        self.fold = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        result = shaped(rows, "source_key", ["text", "toc_ids"], PROVISION)
        if not isinstance(rows.dataType["toc_ids"].dataType, ArrayType):
            raise ValueError("toc_ids must be an array")
        return result

    def eval(self, row: Row):
        if self.fold is None:
            self.key, self.fold = row["source_key"], StatuteFold(None if row["toc_ids"] is None else set(row["toc_ids"]))
        for provision in self.fold.take(row["text"]):
            yield self.key, *provision

    def terminate(self):
        if self.fold is not None:
            for provision in self.fold.end():
                yield self.key, *provision


def register(spark: SparkSession) -> None:
    """``split_clauses`` and ``split_statutes`` for the session's SQL."""
    spark.udtf.register("split_clauses", SplitClauses)
    spark.udtf.register("split_statutes", SplitStatutes)


def clauses(elements: DataFrame, **limits) -> DataFrame:
    """``ClauseFold`` of each document; elements: doc_id, elem_ix, page_number, text."""
    return folded(elements, "doc_id", ["text", "page_number"], CLAUSE, lambda: ClauseFold(**limits))


def statutes(lines: DataFrame) -> DataFrame:
    """``StatuteFold`` of each source; lines: source_key, elem_ix, text, toc_ids."""
    if not isinstance(lines.schema["toc_ids"].dataType, ArrayType):
        raise ValueError("toc_ids must be an array")
    return folded(lines, "source_key", ["text"], PROVISION, lambda ids: StatuteFold(None if ids is None else set(ids)), ("toc_ids",))


def titles(elements: DataFrame, **limits) -> DataFrame:
    """``TitleFold`` of each document; elements: doc_id, elem_ix, category, text."""
    return folded(elements, "doc_id", ["text", "category"], TITLED, lambda: TitleFold(**limits))
