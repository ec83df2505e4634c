"""Table functions in SQL against folds of whole documents in plain Python."""

import random
import re

import pytest

from folioscope.operators import corpus, ingest, splitters

LINE = "source_key string, elem_ix int, text string, toc_ids array<string>"
ELEMENT = "doc_id long, elem_ix int, page_number int, text string"


def clauses_of(rows, most, start=40, least=10):
    """Chunks of a document by slicing at breaks that are found first."""
    rows = [(t, p) for _, _, p, t in rows if t and t.strip()]
    breaks, size = [], 0
    for i, (t, _) in enumerate(rows):
        if i and (size >= most or (re.match(r"\s*\d+(\.\d+){0,3}\.?\s+\S", t) and size >= start)):
            breaks.append(i)
            size = 0
        size += len(t.strip()) + 1
    pieces = [rows[a:b] for a, b in zip([0, *breaks], [*breaks, len(rows)]) if b > a]
    out = []
    for piece in pieces:
        text = "\n".join(t.strip() for t, _ in piece)
        heads = [t.strip()[:120] for t, _ in piece if re.match(r"\s*\d+(\.\d+){0,3}\.?\s+\S", t)]
        if len(text) >= least:
            out.append((len(out) + 1, heads[0] if heads else None, next((p for _, p in piece if p is not None), None), text))
    return out


def test_clauses_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "  ", "1. Fees", " 2.1 Term of it", "x" * 30, "y" * 90, "tiny", "3.", "é" * 55, "z" * 4000]
    docs = {d: [(d, i, rng.choice([None, 1, 2, 9]), rng.choice(texts)) for i in range(n)] for d, n in [(1, 40), (2, 1), (3, 300), (4, 0), (None, 25)]}
    rows = [r for d in docs.values() for r in d]
    rng.shuffle(rows)
    elements = spark.createDataFrame(rows, ELEMENT).selectExpr("*", "'clash' as chunk_index", "1 as heading")
    for limits in ({}, {"max_chars": 100}):
        want = sorted((str(d), *c) for d, r in docs.items() for c in clauses_of(r, limits.get("max_chars", 3000)))
        assert sorted((str(r[0]), *r[1:]) for r in ingest.clause_chunks(elements, **limits).collect()) == want
    splitters.register(spark)
    elements.createOrReplaceTempView("some_elements")
    got = spark.sql("select * from split_clauses(table(some_elements), max_chars => 100)").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert ingest.clause_chunks(elements.where("false")).count() == 0


def test_only_named_columns_are_sent_and_one_shuffle_is_made(spark):
    elements = spark.createDataFrame([(1, 0, 1, "some text here")], ELEMENT).selectExpr("*", "repeat('w', 1000) as ballast").cache()
    plan = ingest.clause_chunks(elements)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ballast, ballast" not in plan


def test_wrong_tables_are_refused_by_name(spark):
    splitters.register(spark)
    with pytest.raises(Exception, match="lacks elem_ix, toc_ids"):
        spark.sql("select * from split_statutes(table(select 'a' as source_key, 'b' as text))")
    with pytest.raises(Exception, match="toc_ids must be an array"):
        spark.sql("select * from split_statutes(table(select 'a' as source_key, 0 as elem_ix, 'b' as text, 'c' as toc_ids))")


def test_statutes_with_and_without_a_table_of_contents(spark):
    text = [
        "THE EXAMPLE ACT", "CHAPTER I", None, "1. Short title.—This Act may be called so.", "1. Subs. by Act 5.", "2. Definitions.—In this Act,", "court means a court. 1[16. Limitation.—None.]",
        "", "PART II", "17. [Repealed.]", "2. Definitions again.—Twice.", "18A. Costs. The court may award costs", "to  either\tparty.", "first schedule", "19. Not a section",
    ]
    rows = [(k, i, t, ids) for k, ids in (("a", None), ("b", ["2", "17"]), ("c", []), (None, None)) for i, t in enumerate(text)]
    got = {}
    for r in corpus.statutes(spark.createDataFrame(rows, LINE).orderBy("text")).collect():
        got.setdefault(r.source_key, []).append((r.ix, r.chapter, r.section_id, r.title, r.text, r.repealed))
    whole = [
        (1, "CHAPTER I", "1", "Short title", "This Act may be called so.", False), (2, "CHAPTER I", "2", "Definitions", "In this Act, court means a court.", False),
        (3, "CHAPTER I", "16", "Limitation", "None.]", False), (4, "PART II", "17", "Repealed", "[Repealed.]", True), (5, "PART II", "18A", "Costs", "The court may award costs to either party.", False),
    ]
    assert sorted(got[None]) == sorted(got["a"]) and "c" not in got
    assert [r[:4] for r in sorted(got["a"])] == [r[:4] for r in whole]
    assert {r[2]: r[4] for r in got["a"]}["18A"] == whole[4][4] and {r[2]: r[4] for r in got["a"]}["2"] == whole[1][4]
    assert [r[2] for r in sorted(got["b"])] == ["2", "17"]
    assert sorted(got["b"])[0][4] == "In this Act, court means a court. 1[16. Limitation.—None.]"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statutes_go_on_in_the_next_batch_and_equal_the_table_function(spark, small_batches):
    text = ["CHAPTER I", "1. Short title.—This Act", "court 1[16. Limitation.—None.]", "", None, "1. Subs. by Act 5.", "2. Costs.  [x", "to\u2003either\tparty [1]", "17. [Repealed.]", "1. Again", "second schedule", "3. No"]
    rng = random.Random(4)
    rows = [(k, i, rng.choice(text), ids) for k, ids in (("a", None), ("b", ["2", "17"]), (None, None), ("d", []), ("e", ["1"])) for i in range(rng.randint(1, 40))]
    lines = spark.createDataFrame(rows, LINE)
    found = corpus.statutes(lines)
    splitters.register(spark)
    lines.createOrReplaceTempView("some_lines")
    want = spark.sql("select * from split_statutes(table(some_lines))")
    assert found.schema == want.schema and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "MapInArrow" in plan_of(found) and "UDTF" not in plan_of(found)  # no call for each row
    with pytest.raises(ValueError, match="toc_ids must be an array"):
        splitters.statutes(lines.withColumn("toc_ids", lines["text"]))


def test_clauses_go_on_in_the_next_batch(spark, small_batches):
    rng = random.Random(5)
    docs = {d: [(d, i, rng.choice([None, 1, 2]), rng.choice(["", None, "1. Fees", " 2.1 Term of it", "x" * 30, "é" * 55, "z" * 4000])) for i in range(n)] for d, n in [(1, 40), (2, 1), (3, 100), (None, 25)]}
    chunks = ingest.clause_chunks(spark.createDataFrame([r for d in docs.values() for r in d], ELEMENT), max_chars=100)
    assert sorted((str(r[0]), *r[1:]) for r in chunks.collect()) == sorted((str(d), *c) for d, r in docs.items() for c in clauses_of(r, 100))
    assert "MapInArrow" in plan_of(chunks) and "UDTF" not in plan_of(chunks)


def test_titles_go_on_in_the_next_batch(spark, small_batches):
    rng = random.Random(6)
    rows = [(d, i, rng.choice(["Title", "NarrativeText", None]), rng.choice([None, "", "A", "b" * 90, "é" * 600, "c" * 7000])) for d, n in ((1, 60), (2, 1), (3, 20)) for i in range(n)]
    chunks = ingest.title_chunks(spark.createDataFrame(rows, "doc_id long, elem_ix int, category string, text string").orderBy("text"))
    want = []
    for d in (1, 2, 3):
        texts = []
        for _, _, category, text in (r for r in rows if r[0] == d):
            for piece in [(text or "")[i : i + 3000] for i in range(0, len(text or ""), 3000)]:
                size = len(texts[-1]) if texts else 3000
                if size >= 2400 or size + len(piece) + 2 > 3000 or (category == "Title" and size >= 500):
                    texts.append(piece)
                else:
                    texts[-1] += "\n\n" + piece
        want += [(d, i, t) for i, t in enumerate(texts, 1)]
    assert sorted(map(tuple, chunks.collect())) == want
    assert "MapInArrow" in plan_of(chunks) and "FlatMapGroups" not in plan_of(chunks)
