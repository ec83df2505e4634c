"""Searches within a scope, against brute force: versions in force, several documents, several phrasings, sub-queries."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from folioscope import providers
from folioscope.operators import corpus, retrieval

DAY = dt.date(2000, 1, 1)
EDGES = [None, dt.date(1, 1, 1), dt.date(1969, 12, 31), DAY, dt.date(2000, 2, 29), dt.date(9999, 12, 31)]


def test_a_date_meets_an_interval_in_one_node_or_in_none(spark):
    spans = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in EDGES for b in EDGES)]
    days = [(i, d) for i, d in enumerate(EDGES[1:] + [DAY + dt.timedelta(n) for n in (-1, 1, 58, 59, 60)])]
    left = spark.createDataFrame(spans, "id int, a date, b date").select("id", F.explode(corpus.interval_nodes(F.col("a"), F.col("b"))).alias("node"))
    right = spark.createDataFrame(days, "day int, d date").select("day", F.explode(corpus.date_nodes(F.col("d"))).alias("node"))
    got = [(r.id, r.day) for r in left.join(right, "node").collect()]
    want = {(i, n) for i, a, b in spans for n, d in days if (a is None or a <= d) and (b is None or d <= b)}
    assert set(got) == want and len(got) == len(want)


def versions(rng, n=300):
    rows = []
    for i in range(n):
        first = None if i % 17 == 0 else DAY + dt.timedelta(int(rng.integers(0, 900)))
        last = None if i % 19 == 0 else (first or DAY) + dt.timedelta(int(rng.integers(-5, 300)))
        v = None if i % 97 == 5 else rng.normal(size=4).tolist()
        rows.append((i, v, first, last, [None, False, False, True][i % 4] if i % 5 == 0 else False, ["", None, " ", "x"][i % 4] if i % 3 == 0 else None))
    return rows


def test_as_of_search(spark):
    rng = np.random.default_rng(3)
    rows = versions(rng)
    rows += [(1000 + i, rows[1][1], *rows[1][2:]) for i in range(4)]  # copies tie
    asked = [(q, rng.normal(size=4).tolist(), None if q % 5 == 0 else DAY + dt.timedelta(int(rng.integers(-200, 1400)))) for q in range(20)]
    asked += [(20, rows[1][1], rows[1][2]), (21, None, DAY), (22, rng.normal(size=4).tolist(), dt.date(1, 1, 1)), (23, rng.normal(size=4).tolist(), dt.date(9999, 12, 31))]
    unit = lambda v: np.array(v) / np.linalg.norm(v)

    def holds(day, row):
        _, _, first, last, repealed, newer = row
        if repealed or (newer or "").strip():
            return False
        return day is None or ((first is None or day >= first) and (last is None or day <= last))

    want, k = {}, 4
    for q, v, day in asked:
        if v is None:
            continue
        ranked = sorted((-round(float(unit(v) @ unit(r[1])), 12), r[0], holds(day, r)) for r in rows if r[1] is not None)
        want |= {(q, i): (n, sum(not h for *_, h in ranked[: 2 * k])) for n, (_, i, _) in enumerate([r for r in ranked if r[2]][:k], 1)}
    df = spark.createDataFrame(rows, "id int, embedding array<double>, enacted_date date, as_of_date date, repealed boolean, superseded_by string")
    questions = spark.createDataFrame(asked, "query_id int, query_vector array<double>, as_of date")
    found = corpus.as_of_search(df, questions, k).collect()
    assert {(r.query_id, r.id): (r["rank"], r.withheld) for r in found} == want and len(found) == len(want)
    assert corpus.as_of_search(df.limit(0), questions, k).count() == 0
    assert corpus.as_of_search(df, questions.limit(0), k).count() == 0


def test_search_by_blocks_of_a_hot_group(spark, monkeypatch):
    """Most rows are in one group, which is split into blocks; the others are small."""
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 4 else f"g{i % 7}", rng.normal(size=3).tolist()) for i in range(400)] + [(900, None, [1.0, 0.0, 0.0])]
    asked = [(q, g, rng.normal(size=3).tolist()) for q in range(8) for g in ("hot", f"g{q}")] + [(9, None, [1.0, 0.0, 0.0])]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = set()
    for q in range(8):
        own = {g: unit(v) for i, g, v in asked if i == q}
        best = sorted((-round(float(own[g] @ unit(v)), 12), i) for i, g, v in rows if g in own)[:6]
        want |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    got = retrieval.dense_top(spark.createDataFrame(rows, "id int, g string, embedding array<double>"), spark.createDataFrame(asked, "query_id int, g string, query_vector array<double>"), 6, "id", meet="g").collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want and len(got) == len(want)


ROWS = [(i, f"d{i % 10}", [float(i % 3 + 1), float(i)], f"text {'alpha' if i % 20 == 0 else 'beta'} {i}") for i in range(60)]


def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id int, doc_id string, embedding array<double>, text string")


def test_documents_of_a_scope_are_all_there(spark):
    scopes = {1: ["d1"], 2: ["d3", "d1", "d3", None], 3: ["d1", "d2", "d3"], 4: [f"d{i}" for i in range(9, -1, -1)], 5: [], 6: None, 7: ["none", "d2"]}
    asked = spark.createDataFrame([(q, "alpha", [1.0, 2.0], s) for q, s in scopes.items()], "query_id int, query string, query_vector array<double>, scope array<string>")
    for rerank in (None, providers.rerank):
        got = {}
        for r in retrieval.across_documents(chunks(spark), asked, rerank=rerank).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_id, r["rank"]))
        runs = {q: [d for d, *_ in rows] for q, rows in got.items()}
        assert runs == {1: ["d1"] * 4, 2: ["d3"] * 4 + ["d1"] * 4, 3: ["d1"] * 3 + ["d2"] * 3 + ["d3"] * 3, 4: [f"d{i}" for i in range(9, 1, -1) for _ in range(2)], 7: ["d2"] * 4}
        assert all([n for *_, n in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    by_score = lambda d: [i for i, *_ in sorted((r for r in ROWS if r[1] == d), key=lambda r: (-np.dot(r[2], [1, 2]) / np.linalg.norm(r[2]), r[0]))]
    first = retrieval.across_documents(chunks(spark), asked.where("query_id = 1")).orderBy("rank").collect()
    assert [r.chunk_id for r in first] == by_score("d1")[:4]


def test_scoped_retrieval_takes_the_path_of_its_scope(spark):
    asked = spark.createDataFrame([(1, "alpha", [1.0, 2.0], None), (2, "alpha", [1.0, 2.0], ["d0"]), (3, "alpha", [1.0, 2.0], ["d0", "d1"]), (4, "alpha", [1.0, 2.0], [])], "query_id int, query string, query_vector array<double>, scope array<string>")
    got = {}
    for r in retrieval.retrieve_scoped(chunks(spark), asked, 3).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id % 10)
    assert got[2] == {0} and got[3] == {0, 1} and len(got[1]) >= 1 and 4 not in got


def test_phrasings_count_equal_texts_once(spark):
    rows = [(1, [1.0, 0.0], "same words"), (2, [1.0, 0.1], "same words"), (3, [0.0, 1.0], "other word"), (4, [0.1, 1.0], None), (5, [0.2, 1.0], None)]
    df = spark.createDataFrame(rows, "doc_id int, embedding array<double>, text string")
    variants = spark.createDataFrame([(1, 0, "other", [1.0, 0.0]), (1, 1, "same", [0.0, 1.0]), (2, 3, "same", [0.0, 1.0])], "query_id int, sub_ix int, query string, query_vector array<double>")
    got = {}
    for r in retrieval.multi_query(df, variants, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert sorted(got[1]) == [1, 3, 5] and sorted(got[2]) == [2, 3, 4]  # each text under the id where it was first seen
    assert got[1][0] == 3 and got[2][0] == 2  # the first phrasing's word decides


def test_original_is_asked_where_its_parts_find_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<double>")
    whole = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, -1.0])], "query_id int, query_vector array<double>")
    parts = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [0.0, 1.0]), (2, 0, [-1.0, 0.0])], "query_id int, sub_ix int, query_vector array<double>")
    got = {(r.query_id, r.id, r["rank"], r.original) for r in retrieval.with_original(df, whole, parts, 3, "id", 0.5).collect()}
    assert got == {(1, 2, 1, False), (2, 1, 1, True)}
