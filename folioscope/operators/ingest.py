"""From elements to chunks: boilerplate, document classes, fiscal years, clause chunks, ids, exact dedup, summaries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import splitters
from folioscope.operators.splitters import ClauseFold, TitleFold


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, elem_ix, text): each line of a document as an element, from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("elem_ix", "text"))


def is_boilerplate(text: Column) -> Column:
    """Empty, or short and next to nothing without time stamps, URLs, page numbers and separators."""
    bare = F.trim(text)
    residue = reduce(lambda t, p: F.regexp_replace(t, p, " "), (P.PRINT_TIMESTAMP, P.BARE_URL, P.PAGE_N_OF_M), bare)
    short = F.length(bare) <= P.CHROME_MOST_CHARS
    return F.coalesce(text == "", F.lit(True)) | (short & (F.length(F.regexp_replace(residue, P.SEPARATORS, "")) < P.CHROME_LEAST_RESIDUE))


def without_boilerplate(elements: DataFrame) -> DataFrame:
    return elements.where(~is_chrome_category(elements)).where(~is_boilerplate(F.col("text")))


def is_chrome_category(elements: DataFrame) -> Column:
    return F.lower("category").isin(*P.CHROME_CATEGORIES) if "category" in elements.columns else F.lit(False)


def boilerplate_report(elements: DataFrame) -> DataFrame:
    """Per document: elements dropped by category and by pattern, kept, total."""
    chrome, pattern = is_chrome_category(elements), is_boilerplate(F.col("text"))
    return elements.groupBy("doc_id").agg(
        F.count_if(chrome).alias("by_category"), F.count_if(~chrome & pattern).alias("by_pattern"),
        F.count_if(~chrome & ~pattern).alias("kept"), F.count("*").alias("total"),
    )


def element_kind(type_name: Column, text: Column) -> Column:
    """table, image or text, by the element's type name; null without text."""
    name = F.lower(type_name)
    return F.when(name.contains("table"), "table").when(name.contains("image"), "image").when(F.length(text) > 0, "text")


def text_density(pages: DataFrame, by: str, sample: int | None = None) -> DataFrame:
    """Characters of text per page of each document (``by``, page_no, text), over its first ``sample`` pages or all; pages without
    text count as empty ones."""
    taken = pages if sample is None else pages.where(F.col("page_no") < sample)
    return taken.groupBy(by).agg(F.count("*").alias("pages"), F.round(F.avg(F.length(F.coalesce("text", F.lit("")))), 6).alias("density"))


def without_legal_tables(table_chunks: DataFrame, classes: DataFrame) -> DataFrame:
    """Table chunks but those of documents that were classified (doc_id, doc_type) as legal prose."""
    return table_chunks.join(classes.where("doc_type = 'legal_contract'").select("doc_id"), "doc_id", "left_anti")


def classify(elements: DataFrame, name: str) -> DataFrame:
    """Per document: heading ratio, dollars per element, and the class they and the file name (column ``name``) speak for."""
    text = F.col("text")
    kept = elements.where(F.trim(text) != "")
    per = kept.groupBy("doc_id").agg(
        (F.count_if(F.trim(text).rlike(P.HEADING)) / F.greatest(F.count("*"), F.lit(1))).alias("head_ratio"),
        (F.sum(F.length(text) - F.length(F.replace(text, F.lit("$")))) / F.greatest(F.count("*"), F.lit(1))).alias("dollar_density"),
        F.lower(F.min(name)).alias("name"),
    )
    hint = lambda names: reduce(lambda a, b: a | b, (F.coalesce(F.col("name"), F.lit("")).contains(n) for n in names))
    head, dollars = F.col("head_ratio"), F.col("dollar_density")
    legal = ((head >= 0.15) & (dollars < 0.08)) | (hint(P.LEGAL_NAMES) & (head >= 0.05) & (dollars < 0.10))
    financial = ((dollars >= 0.10) & (head < 0.05)) | (hint(P.FINANCIAL_NAMES) & (dollars >= 0.05))
    kind = F.when(legal & ~financial, "legal_contract").when(financial & ~legal, "financial_filing").when(legal & financial, "mixed").otherwise("generic")
    return per.select("doc_id", F.round("head_ratio", 6).alias("head_ratio"), F.round("dollar_density", 6).alias("dollar_density"), kind.alias("doc_type"))


def _in_window(year: Column) -> Column:
    return F.when(year.between(P.YEAR_MIN, P.YEAR_MAX), year)


def fiscal_year_from_name(name: Column) -> Column:
    """From a date, else a fiscal-year tag, else a bare year in the name; null outside the window."""
    found = lambda pattern, group: F.try_to_number(F.nullif(F.regexp_extract(name, pattern, group), F.lit("")), F.lit("9999")).cast("int")
    tag = found(P.NAME_FY, 1)
    tag = F.when(F.length(F.regexp_extract(name, P.NAME_FY, 1)) == 2, tag + 2000).otherwise(tag)
    return F.coalesce(_in_window(found(P.NAME_DATE, 2)), _in_window(tag), _in_window(found(P.NAME_YEAR, 2)))


def fiscal_year(name: Column, periods: Column) -> Column:
    """The name's year, else the latest year in the period headers."""
    year = lambda p: F.try_to_number(F.nullif(F.regexp_extract(p, P.NAME_YEAR, 2), F.lit("")), F.lit("9999")).cast("int")
    return F.coalesce(fiscal_year_from_name(name), F.array_max(F.transform(periods, year)))


def marked_chunks(elements: DataFrame, is_mark: Column, order: str = "elem_ix") -> DataFrame:
    """Elements joined into chunks, a new chunk at each marked element: (doc_id, chunk_ix, n_elements, text)."""
    here = Window.partitionBy("doc_id").orderBy(order)
    numbered = elements.withColumn("chunk_ix", F.sum(is_mark.cast("int")).over(here))
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return numbered.groupBy("doc_id", "chunk_ix").agg(F.count("*").alias("n_elements"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def fold_clauses(rows: pd.DataFrame, max_chars: int = 3000, **options) -> pd.DataFrame:
    """``ClauseFold`` of one document's elements in order."""
    fold = ClauseFold(max_chars, **options)
    out = [chunk for text, page in zip(rows["text"], rows["page_number"]) for chunk in fold.take(text, page)] + list(fold.end())
    chunks = pd.DataFrame(out, columns=["chunk_index", "heading", "page_number", "text"])
    chunks.insert(0, "doc_id", rows["doc_id"].iloc[0] if len(rows) else None)
    return chunks


def clause_chunks(elements: DataFrame, max_chars: int = 3000, **options) -> DataFrame:
    """``ClauseFold`` per document, row by row; elements: doc_id, elem_ix, page_number, text."""
    return splitters.clauses(elements, max_chars=max_chars, **options)


def pack_titles(rows: pd.DataFrame, **limits) -> pd.DataFrame:
    """``TitleFold`` of one document's elements in order."""
    fold = TitleFold(**limits)
    out = [chunk for text, category in zip(rows["text"], rows["category"]) for chunk in fold.take(text, category)] + list(fold.end())
    chunks = pd.DataFrame(out, columns=["chunk_index", "text"])
    chunks.insert(0, "doc_id", rows["doc_id"].iloc[0] if len(rows) else None)
    return chunks


def title_chunks(elements: DataFrame, **limits) -> DataFrame:
    """``TitleFold`` per document, row by row; elements: doc_id, elem_ix, category, text."""
    return splitters.titles(elements, **limits)


def numbered_chunks(chunks: DataFrame, order: str = "elem_ix", least_chars: int = 10) -> DataFrame:
    """``chunk_index`` from 1 over all chunks of a document; then those under ``least_chars`` go."""
    here = Window.partitionBy("doc_id").orderBy(order)
    return chunks.withColumn("chunk_index", F.row_number().over(here)).where(F.length(F.trim("text")) >= least_chars)


def stable_id(file: Column, kind: Column, index: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("::", file, kind, index.cast("string"), text))


def dedup_exact(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first row, by ``order``, of each distinct text, with content_hash and vector_id (source::hash)."""
    hashed = rows.withColumn("content_hash", F.sha2("text", 256))
    first = hashed.withColumn("__n", F.row_number().over(Window.partitionBy("content_hash").orderBy(order))).where("__n = 1").drop("__n")
    return first.withColumn("vector_id", F.concat_ws("::", F.coalesce("source", F.lit("unknown")), "content_hash"))


def clean_metadata(metadata: Column) -> Column:
    """A string map without its null values."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull())


def table_description(text: Column) -> Column:
    """The first five non-blank lines, joined by spaces, in 200 characters."""
    full = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(F.slice(full, 1, 5), " "), 1, 200)


def image_description(alt: Column, caption: Column, page: Column) -> Column:
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(alt), given(caption), F.concat(F.lit("Image on page "), page.cast("string")), F.lit("Image"))


def extractive_summary(chunks: DataFrame, most: int = 400) -> DataFrame:
    """Per document the first chunks, joined by spaces, in ``most`` characters; each gives what the budget has left."""
    here = Window.partitionBy("doc_id").orderBy("elem_ix").rowsBetween(Window.unboundedPreceding, -1)
    bare = chunks.withColumn("text", F.trim("text")).where("text <> ''")
    used = bare.withColumn("used", F.coalesce(F.sum(F.length("text")).over(here), F.lit(0))).where(F.col("used") < most)
    cut = used.withColumn("part", F.expr(f"substring(text, 1, cast({most} - used as int))"))
    parts = F.array_sort(F.collect_list(F.struct("elem_ix", "part")))
    return cut.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["part"]), " "), 1, most).alias("summary"))


def centroids(vectors: DataFrame, group: str, order: str, most: int = 50) -> DataFrame:
    """(group, dim, mean) over at most ``most`` first vectors of each group."""
    first = vectors.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") <= most)
    return first.select(group, F.posexplode("embedding").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def parse_strategy(extension: Column, pages: Column, density: Column, fallback: str = "auto") -> Column:
    """fast, auto or hi_res by file type, page count and text density (characters a page)."""
    small = F.lower(extension)
    return (
        F.when(small.isin("txt", "md"), "fast").when(small.isin("docx", "pptx", "xlsx"), "auto").when(pages <= 0, fallback)
        .when(pages <= 10, "fast").when(density >= 100, "fast").otherwise("hi_res")
    )


def size_queue(n_bytes: Column) -> Column:
    return F.when(n_bytes < 500_000, "fast").when(n_bytes < 5_000_000, "normal").otherwise("heavy")


def html_to_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, the five basic entities are read, spaces collapse."""
    bare = reduce(lambda t, p: F.regexp_replace(t, p, " "), (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"), html)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def repair_bytes(data: bytes) -> str:
    """UTF-8 text: line feeds inside a multi-byte character go; what is not UTF-8 is read as Windows-1252."""
    out = bytearray()
    i = 0
    while i < len(data):
        b = data[i]
        width = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        taken, j = bytearray([b]), i + 1
        while len(taken) < width and j < len(data) and (data[j] in (0x0A, 0x0D) or 0x80 <= data[j] < 0xC0):
            if data[j] >= 0x80:
                taken.append(data[j])
            j += 1
        if width > 1 and len(taken) == width:
            out += taken
            i = j
        elif b < 0x80:
            out.append(b)
            i += 1
        else:
            after_stop = b == 0x94 and bytes(out).rstrip()[-1:] == b"."
            out += ("—" if after_stop else bytes([b]).decode("cp1252", "replace")).encode()
            i += 1
    return out.decode("utf-8", "replace")


def repaired(data: Column) -> Column:
    def repair(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else repair_bytes(bytes(v)))

    return F.pandas_udf(repair, "string")(data)
