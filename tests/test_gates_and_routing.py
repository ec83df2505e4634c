"""Lists in questions, numbers in answers, tenants, access, and diverse searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import govern, retrieval, verify
from folioscope.sources import files

LISTS = [
    ("compare AMZN, GOOG, and MSFT revenue in FY2023", ["AMZN", "GOOG", "MSFT"]),
    ("for each of the following clauses: governing law, payment terms, liability", ["governing law", "payment terms", "liability"]),
    ("Contrast Acme and Globex", ["Acme", "Globex"]),
    ("difference between A and B with respect to tax", ["A", "B"]),
    ("What changed between 2020 and 2022?", []),
    ("Compare Acme", []),
    ("For each of 2020 and 2022. Give totals", ["2020", "2022"]),
    (None, []),
]


@pytest.mark.parametrize("question, names", LISTS)
def test_lists_in_questions(spark, question, names):
    df = spark.createDataFrame([(question,)], "question string").select(verify.entities_asked(F.col("question")).alias("e"))
    assert df.first().e == names


def test_completeness_of_good_answers(spark):
    rows = [(1, LISTS[0][0], "AMZN reported 5, GOOG 6 and MSFT 7."), (2, LISTS[0][0], "AMZN reported 5 and GOOG 6."), (3, LISTS[1][0], "Governing law is English; payment terms are net 30; liability could not be found."), (4, "x", None)]
    got = {r.id: (r.dropped, r.complete) for r in verify.completeness(spark.createDataFrame(rows, "id int, question string, answer string"), "id").collect()}
    assert got == {1: ([], True), 2: (["MSFT"], False), 3: ([], True), 4: ([], True)}


def test_numbers_of_answers(spark):
    texts = spark.createDataFrame([(1, "250 units in 2023, 99 people, (1,234) and $999 million, 12.5%"), (2, "none in 1999"), (3, None), (4, "0.0 and 0.005 and 0.02")], "id int, text string")
    allowed = spark.createDataFrame([(252.0,), (-1234.0,), (0.0,), (None,)], "value double")
    got = {r.id: (r.checked, r.ungrounded, r.ok) for r in verify.number_check(texts, allowed, "id").collect()}
    assert got == {1: (4, 2, False), 2: (0, 0, True), 3: (0, 0, True), 4: (3, 1, False)}


def test_namespaces_that_look_like_numbers_and_dates_stay_apart(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "namespace string, doc_id int, chunk_index int, text string"
    for rows in ([("001", 1, 1, "a"), ("2024-01-01", 1, 1, "d"), (None, 1, 1, "n")], [("1", 1, 1, "z"), ("1", 1, 2, "y")], [("001", 2, 1, "b"), (None, 2, 1, "m")]):
        files.write_chunks(spark.createDataFrame(rows, schema), path)
    got = {(r.namespace, r.doc_id, r.text) for r in files.read_chunks(spark, path).collect()}
    assert got == {("001", 1, "a"), ("001", 2, "b"), ("1", 1, "z"), ("1", 1, "y"), ("2024-01-01", 1, "d"), (None, 1, "n"), (None, 2, "m")}


def test_members_see_no_vault_of_another_firm(spark):
    vaults = spark.createDataFrame([(10, 1, 5), (20, 2, 6)], "vault_id int, firm_id int, owner_id int")
    members = spark.createDataFrame([(1, 1, "associate"), (2, 1, "partner")], "user_id int, firm_id int, role string")
    staffed = spark.createDataFrame([(1, 10), (1, 20), (2, 20)], "user_id int, vault_id int")
    none = spark.createDataFrame([], "user_id int, vault_id int, removed_at string")
    assert {tuple(r) for r in govern.visible(vaults, members, staffed, none).collect()} == {(1, 10), (2, 10)}


def test_nearest_entries_of_other_lengths_and_odd_vectors(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [])], "entry_id long, embedding array<double>").collect()
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 2.0, 0.0]), (3, None), (4, [1.0, float("inf")]), (5, [1.0])], "query_id long, query_vector array<double>")
    assert {(r.query_id, r.near_id) for r in retrieval.nearest_entries(asked, entries, 0.9).collect()} == {(1, 1), (2, 2)}


def greedy_by_hand(question, rows, rated, k, weight):
    """rows: id -> vector; rated: id -> relevance."""
    cos = lambda a, b: 0.0 if not np.linalg.norm(a) * np.linalg.norm(b) else float(np.dot(a / np.linalg.norm(a), b / np.linalg.norm(b)))
    relevance = {i: round(cos(v, question), 12) for i, v in rows.items()} | rated
    if len(relevance) <= k:
        return sorted(relevance, key=lambda i: (-relevance[i], i))
    chosen = []
    while len(chosen) < k:
        def key(i):
            like = [round(cos(rows[i], rows[j]), 12) for j in chosen if j in rows] if i in rows else []
            return -round(weight * relevance[i] - (1 - weight) * max(like, default=0.0), 12), -relevance[i], i

        chosen.append(min((i for i in relevance if i not in chosen), key=key))
    return chosen


@pytest.mark.parametrize("ahead, row_block, question_block", [(96, 16_384, 256), (6, 150, 3)])
def test_diverse_search_equals_brute_force(spark, monkeypatch, ahead, row_block, question_block):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", row_block)
    monkeypatch.setattr(retrieval, "GROUPED_BLOCK", question_block)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=6)
    rows = {i: centre for i in range(250)} | {i: rng.normal(size=6) for i in range(250, 400)} | {400: np.zeros(6)}
    asked = {0: centre, 1: rng.normal(size=6), 2: rng.normal(size=6), 3: -centre, 4: np.zeros(6)}
    rated = {(q, 1000 + i): round(0.07 * i, 6) for q in asked if q % 2 for i in range(12)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()] + [(500, None), (None, [1.0] * 6), (501, [1.0]), (502, [float("nan")] * 6)], "id long, embedding array<double>")
    questions = spark.createDataFrame([(q, v.tolist()) for q, v in asked.items()] + [(9, None)], "query_id long, query_vector array<double>")
    more = spark.createDataFrame([(q, i, r) for (q, i), r in rated.items()], "query_id long, id long, relevance double")
    found = retrieval.diverse_top(df.unionByName(df.where("id < 5")), questions, ahead=ahead, rated=more).orderBy("query_id", "rank").collect()
    got = {q: [r.id for r in found if r.query_id == q] for q in asked}
    assert got == {q: greedy_by_hand(v, rows, {i: r for (of, i), r in rated.items() if of == q}, 12, 0.7) for q, v in asked.items()}
    few = retrieval.diverse_top(df.where("id between 248 and 255"), questions, ahead=ahead).collect()
    assert {q: [r.id for r in sorted(few, key=lambda r: r.rank) if r.query_id == q] for q in asked} == {q: greedy_by_hand(v, {i: rows[i] for i in range(248, 256)}, {}, 12, 0.7) for q, v in asked.items()}


def test_routes_without_topics_go_by_words(spark):
    docs = spark.createDataFrame([(1, None, "lease rent deposit", "a.pdf"), (2, None, " ", "rent-roll.pdf"), (3, [1.0, 0.0], None, "c.pdf"), (4, None, None, "other.pdf")], "id long, topic array<double>, summary string, filename string")
    asked = spark.createDataFrame([(1, "rent deposit", [0.9, 0.1])], "query_id long, query string, query_vector array<double>")
    got = [(r.id, round(r.relevance, 3)) for r in retrieval.route(docs, asked).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 0.994), (2, 0.5), (4, 0.0)]
