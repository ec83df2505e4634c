"""Cases that tables don't have: order, ties, nulls, tampering, late rows, state machines, files."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import corpus, govern, ingest, kernel, retrieval, scope, tables, verify
from folioscope.sources import files
from folioscope.streaming import events


def test_bm25_by_hand(spark):
    pool = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "b c c")], "query_id int, query string")
    got = {r.doc_id: r.score for r in retrieval.bm25(pool, asked).collect()}
    idf = np.log(2.5) - np.log(1.5)
    assert got[1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)))
    assert got[2] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    assert 3 not in got


def test_rrf_does_not_depend_on_row_order(spark):
    rows = [(1, d, lst, r) for lst, ids in ((0, [5, 3, 9]), (1, [3, 7, 5])) for r, d in enumerate(ids, 1)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, list int, rank int")
    a = [(r.doc_id, r.rank) for r in retrieval.rrf(df, "doc_id").orderBy("rank").collect()]
    b = [(r.doc_id, r.rank) for r in retrieval.rrf(df.orderBy(F.rand(1)), "doc_id").orderBy("rank").collect()]
    assert a == b and [d for d, _ in a][:2] == [3, 5]


def test_mmr_first_is_most_relevant_and_ties_keep_order():
    vectors = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    chosen = retrieval.mmr_order(np.array([1, 2, 3]), np.array([0.9, 0.9, 0.5]), vectors, 2, 0.7)
    assert [i for i, _ in chosen] == [1, 3]


def test_empty_scope_is_nothing_and_none_is_all(spark):
    df = spark.createDataFrame([(1, "a", 3)], "doc_id int, filename string, page_number int")
    assert df.where(scope.Scope(doc_ids=[]).predicate()).count() == 0
    assert df.where(scope.Scope().predicate()).count() == 1
    assert df.where(scope.Scope(doc_id=1, metadata={"doc_id": 2, "page_number": 3}).predicate()).count() == 1
    assert df.where(scope.in_pages(F.col("page_number").cast("string"), "2-4")).count() == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(-(10**9), 10**9))
def test_parse_cell_round_trip(spark, n):
    shown = f"({abs(n):,})" if n < 0 else f"{n:,}"
    row = spark.createDataFrame([(shown, f"${n}")], "a string, b string").select(kernel.parse_cell(F.col("a")).alias("a"), kernel.parse_cell(F.col("b")).alias("b")).first()
    assert row.a == n and row.b == n


def test_growth_and_margin_by_hand(spark):
    row = spark.range(1).select(*kernel.growth_pct(F.lit(80096.0), F.lit(90757.0))).first()
    assert row.value == pytest.approx(13.3, abs=0.05)
    row = spark.range(1).select(*kernel.ratio(F.lit(24631.0), F.lit(90757.0), F.lit("AWS"), F.lit("AWS"), True)).first()
    assert row.value == pytest.approx(27.1, abs=0.05)
    row = spark.range(1).select(*kernel.ratio(F.lit(1.0), F.lit(2.0), F.lit("AWS"), F.lit("Ads"))).first()
    assert row.value is None and row.error == "different sections"


def test_series_sorts_by_year_only_if_all_keys_have_one(spark):
    rows = [("a", "FY23", 1.0, 1), ("a", "2021", 2.0, 2), ("b", "x", 1.0, 2), ("b", "2020", 2.0, 1)]
    s = kernel.ordered_series(spark.createDataFrame(rows, "series_id string, key string, value double, ix int"))
    got = {(r.series_id, r.series_ix): r.key for r in s.collect()}
    assert got == {("a", 1): "2021", ("a", 2): "FY23", ("b", 1): "2020", ("b", 2): "x"}


def test_clause_fold():
    rows = pd.DataFrame({"doc_id": 1, "page_number": [1, 1, 2, 2], "text": ["1. Engagement", "x" * 60, "2. Fees and other", "y" * 60]})
    out = ingest.fold_clauses(rows, 3000)
    assert out.heading.tolist() == ["1. Engagement", "2. Fees and other"] and out.page_number.tolist() == [1, 2]
    assert ingest.fold_clauses(rows, 3000, compat_page=True).page_number.tolist() == [1, 1]


def test_title_pack_never_grows_over_the_limit():
    rows = pd.DataFrame({"doc_id": 1, "category": ["Title", "Text", "Title", "Text"], "text": ["A", "b" * 7000, "C", "d" * 10]})
    out = ingest.pack_titles(rows)
    assert out.text.map(len).max() <= 3000 and "".join(out.text).replace("\n", "") == "A" + "b" * 7000 + "C" + "d" * 10


def test_encoding_repair():
    assert ingest.repair_bytes("café".encode()) == "café"
    assert ingest.repair_bytes(b"caf\xc3\n\xa9") == "café"
    assert ingest.repair_bytes(b"a\x92b") == "a’b"
    assert ingest.repair_bytes(b"end.\x94") == "end.—"


def chain(spark):
    rows = [(1, i, "x") for i in range(5)]
    return govern.signed(spark.createDataFrame(rows, "firm int, id int, what string"), "firm", "id", ["id", "what"])


def test_chain_tampering(spark):
    rows = chain(spark)
    check = lambda df: govern.verified_chain(df, "firm", ["id", "what"]).first()
    assert check(rows).valid
    assert check(rows.withColumn("what", F.when(F.col("seq") == 2, "y").otherwise(F.col("what")))).first_break == 2
    assert check(rows.where("seq <> 3")).first_break == 4
    assert check(rows.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")))).first_break == 1


def test_figures_scale_and_small_values(spark):
    texts = spark.createDataFrame([(1, "513,983 or $514 or 513.98 but 777,777 and 2022; 0.005")], "id int, text string")
    cells = spark.createDataFrame([(513983.0,), (0.001,)], "value double")
    got = {r.token: r.traces for r in verify.traced(verify.figures(texts, "id"), cells, "id").collect()}
    assert got == {"513,983": True, "$514": True, "513.98": True, "777,777": False, "0.005": True}


def test_snippet(spark):
    row = spark.createDataFrame([("a" * 300 + "needle" + "b" * 300, "needle")], "t string, p string").select(verify.snippet(F.col("t"), F.col("p")).alias("s")).first()
    assert row.s.startswith("…") and "needle" in row.s and row.s.endswith("…")


def sections_by_hand(lines, tolerance=2.0):
    """The stack of open headers, line by line."""
    open_, out = [], {}
    for line, label, x0, n in lines:
        if n == 0:
            while open_ and open_[-1][0] >= x0 - tolerance:
                open_.pop()
            open_.append((x0, label))
        else:
            out[line] = next((h.rstrip(":") for at, h in reversed(open_) if at < x0 - tolerance), "")
    return out


def test_sections_scope_by_indent(spark):
    schema = "doc string, page int, line int, label string, x0 double, n_values int, values array<string>"
    rows = [("d", 1, 0, "Top:", 0.0, 0, []), ("d", 1, 1, "Sub", 10.0, 0, []), ("d", 1, 2, "a", 20.0, 1, ["1"]), ("d", 1, 3, "b", 10.0, 1, ["2"])]
    got = {r.line: r.section for r in tables.scoped_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: "Sub", 3: "Top"}
    rng = np.random.default_rng(3)
    for page in range(2, 6):
        lines = [(i, f"h{i}:" if rng.random() < 0.5 else f"v{i}", float(rng.integers(0, 12)), 0) for i in range(40)]
        lines = [(i, label, x0, int(label[0] == "v")) for i, label, x0, _ in lines]
        df = spark.createDataFrame([("d", page, i, label, x0, n, ["1"] * n) for i, label, x0, n in lines], schema)
        assert {r.line: r.section for r in tables.scoped_rows(df).collect()} == sections_by_hand(lines)


def test_lines_from_words_and_spans(spark):
    schema = "doc string, page int, text string, x0 double, x1 double, top double"

    def line(top, *words):
        return [("d", 1, t, x, x + 10.0, float(top)) for t, x in words]

    rows = [
        *line(10, ("PART", 300.0), ("II", 320.0)), *line(30, ("Assets", 20.0)), *line(42, ("Cash", 30.0), ("$", 190.0), ("1,234", 200.0), ("2,000", 260.0)),
        *line(54, ("Leases", 30.0), ("2.18", 60.0), ("900", 200.0), ("—", 230.0), ("800", 260.0)), *line(66, ("Common", 30.0), ("shares", 50.0), ("24,000", 90.0)),
        *line(78, ("outstanding", 30.0), ("7,519", 90.0), ("120", 200.0), ("130", 260.0)), *line(90, ("Total", 30.0)), *line(93.5, ("5,000", 200.0), ("6,000", 260.0)),
        *line(110, ("footer", 400.0)),
    ]
    lines = tables.lines_from_words(spark.createDataFrame(rows, schema))
    got = [(r.label, r["values"]) for r in lines.orderBy("line").collect()]
    assert got == [
        ("PART II", []), ("Assets", []), ("Cash", ["1,234", "2,000"]), ("Leases 2.18", ["900", "–", "800"]), ("Common shares", ["24,000"]),
        ("outstanding", ["7,519", "120", "130"]), ("Total", ["5,000", "6,000"]), ("footer", []),
    ]
    spans = tables.span_numbers(lines)
    assert [(r.label, r.kind) for r in spans.orderBy("line").collect()] == [("Assets", "header"), ("Cash", "row"), ("Leases 2.18", "over"), ("Common shares", "fragment"), ("outstanding", "over"), ("Total", "row")]
    built = {r.label: r["values"] for r in tables.span_rows(spans).collect()}
    assert built == {"Assets": [], "Cash": ["1,234", "2,000"], "Leases 2.18 900 – 800": [], "Common shares 24,000 outstanding 7,519": ["120", "130"], "Total": ["5,000", "6,000"]}
    assert [r.prose for r in tables.is_prose_span(spans).collect()] == [False]


def test_in_force_is_three_valued(spark):
    d = lambda s: F.lit(s).cast("date")
    at = lambda when: spark.range(1).select(corpus.in_force(d(when), d("1950-01-26"), d("2024-01-01"), F.lit(True)).alias("x")).first().x
    assert at("2020-06-01") is True and at("1949-01-01") is False and at("2030-01-01") is None


def test_breaker_opens_cools_and_closes():
    state, names = ([], "closed", 0.0, 0), []
    for at, ok in [(0, False), (1, False), (2, False), (5, True), (40, True), (41, True), (42, False)]:
        state = events.breaker_step(state, at, ok, 3, 60, 30, 2)
        names.append(state[1])
    assert names == ["closed", "closed", "open", "open", "half_open", "closed", "closed"]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_stream_drops_late_rows_and_equals_its_twin(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    first = [(1, at(1, 0), 1, "a", 1.0), (2, at(5, 0), 1, "a", 1.0)]
    late = [(3, at(1, 30), 1, "a", 1.0), (4, at(5, 10), 1, "a", 1.0)]
    src = tmp_path / "in"
    stream = None
    for part in (first, late):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(src))
        df = events.tumbling_counts(spark.readStream.schema(EVENTS).parquet(str(src)))
        stream = df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
    got = {(r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, 1) in got and (1, 2) not in got  # event 3 came after the watermark had passed
    twin = events.tumbling_counts(spark.createDataFrame(first, EVENTS)).collect()
    assert {(r.start.hour, r.n) for r in twin} == {(1, 1), (5, 1)}


def test_breaker_stream_equals_its_twin(spark, tmp_path):
    calls = [(1, float(i), i % 4 == 0) for i in range(12)]
    df = spark.createDataFrame(calls, "service long, at double, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.breaker(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), most=3)
    q = stream.writeStream.format("memory").queryName("breaker").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("breaker").collect()) == sorted(events.breaker(df, most=3).collect())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Title\n\nBody of the text, which goes on.")
    (tmp_path / "b.html").write_text("<p>Hello <b>there</b></p>")
    (tmp_path / "c.exe").write_bytes(b"x")
    mail = "From: a@b.c\nTo: d@e.f\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=XX\n\n--XX\nContent-Type: text/plain\n\nhi\n--XX\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"note.txt\"\n\nattached\n--XX\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"bad.exe\"\n\nno\n--XX--\n"
    (tmp_path / "m.eml").write_text(mail)
    found = files.scan(spark, str(tmp_path))
    assert {r.status for r in found.where("extension = 'exe'").collect()} == {"skipped"}
    assert [r.category for r in files.parse(found).where("path like '%a.txt'").orderBy("elem_ix").collect()] == ["Title", "NarrativeText"]
    assert [r.text for r in files.parse(found).where("path like '%b.html'").collect()] == ["Hello there"]
    assert [r.name for r in files.attachments(found).collect()] == ["note.txt"]


def test_chunk_sink_prunes_by_namespace(spark, tmp_path):
    rows = [("n1", 1, 1, "a"), ("n1", 1, 1, "a"), ("n2", 2, 1, "b")]
    files.write_chunks(spark.createDataFrame(rows, "namespace string, doc_id int, chunk_index int, text string"), str(tmp_path / "c"))
    assert files.read_chunks(spark, str(tmp_path / "c")).count() == 2
    plan = files.read_chunks(spark, str(tmp_path / "c")).where("namespace = 'n1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(scope.Scope(doc_ids=[1, 2]).predicate()).select("doc_id", "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [1,2])]" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_upsert_batches_hold_both_limits(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("vector_id"), F.repeat(F.lit("x"), 20_000).alias("payload"))
    out = files.upsert_batches(df).groupBy("shard", "batch").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("size"))
    assert out.where("n > 250 or size > 1500000").count() == 0
    # by the bytes that are sent, with rows of very different sizes
    mixed = spark.range(2000).select(F.col("id").cast("string").alias("vector_id"), F.repeat(F.lit("é"), (F.col("id") * 7919 % 60_000).cast("int")).alias("payload"))
    sent = F.octet_length(F.to_json(F.struct("vector_id", "payload")))
    out = files.upsert_batches(mixed).groupBy("shard", "batch").agg(F.count("*").alias("n"), F.sum(sent).alias("size"))
    assert out.where("n > 250 or size > 1500000").count() == 0 and out.agg(F.sum("n")).first()[0] == 2000


def test_chunk_sink_upserts_and_keeps_other_namespaces(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "namespace string, doc_id int, chunk_index int, text string"
    files.write_chunks(spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 2, "stays")], schema), path)
    files.write_chunks(spark.createDataFrame([("b", 1, 1, "other")], schema), path)
    files.write_chunks(spark.createDataFrame([("a", 1, 1, "new"), ("a", 2, 1, "more")], schema), path)
    got = sorted(tuple(r[c] for c in ("namespace", "doc_id", "chunk_index", "text")) for r in files.read_chunks(spark, path).collect())
    assert got == [("a", 1, 1, "new"), ("a", 1, 2, "stays"), ("a", 2, 1, "more"), ("b", 1, 1, "other")]
    assert not (tmp_path / "c__staged").exists()


def test_fallback_only_if_nothing_was_found(spark):
    some, none, web = spark.range(2), spark.range(0), spark.range(10, 12)
    assert files.with_fallback(some, web).count() == 2 and files.with_fallback(none, web).count() == 2


def test_folder_connector(spark, tmp_path):
    from folioscope.sources import connector

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "sub" / "b.PDF").write_bytes(b"yy")
    (tmp_path / "c.exe").write_bytes(b"z")
    rows = connector.read_folder(spark, str(tmp_path))
    assert {(r.name.rpartition("/")[2], r.status, r.n_bytes) for r in rows.collect()} == {("a.txt", "queued", 1), ("b.PDF", "queued", 2), ("c.exe", "skipped", None)}
    assert {r.status: r.files for r in connector.receipt(rows).collect()} == {"queued": 2, "skipped": 1}
    (tmp_path / "none").mkdir()
    assert connector.read_folder(spark, str(tmp_path / "none")).count() == 0


def test_grids_are_read_from_json(spark):
    good = '{"headers": ["label", "2023"], "periods": ["2023"], "rows": [{"label": "a", "2023": "1"}]}'
    rows = [(1, i, "table", good) for i in range(70)] + [(2, 0, "table", "not json"), (2, 1, "text", None)]
    got = files.read_grids(spark.createDataFrame(rows, "doc_id int, chunk_index int, chunk_type string, table_json string")).collect()
    assert len(got) == 60 and got[0].grid.rows == [{"label": "a", "2023": "1"}]


def test_providers_are_injected(spark):
    from folioscope import providers

    pool = spark.createDataFrame([(1, "a b", i, t, i) for i, t in enumerate(["x", "a", "a b"])], "query_id int, query string, id int, text string, rank int")
    assert [r.id for r in providers.rerank(pool, 2).orderBy("final_rank").collect()] == [2, 1]
    assert [r.id for r in providers.rerank(pool, 3).orderBy("final_rank").collect()] == [0, 1, 2]
    never = lambda q, t: pd.Series([0.0] * len(q))
    judged = providers.verify(spark.createDataFrame([("a", "a"), ("a", None)], "claim string, evidence string"), provider=never).collect()
    assert [(r.support, r.verified) for r in judged] == [(0.0, False), (0.5, False)]


def test_section_and_title_shapes(spark):
    toc, body = corpus.toc_and_body(F.col("t"), "THE ACT")
    row = spark.createDataFrame([("THE ACT 1. a THE ACT body",)], "t string").select(toc.alias("a"), body.alias("b")).first()
    assert row.a == "THE ACT 1. a " and row.b == "THE ACT body"
    row = spark.createDataFrame([("no title",)], "t string").select(toc.alias("a"), body.alias("b")).first()
    assert row.a == "" and row.b == "no title"


def test_claims_are_compared_with_all_documents(spark):
    from folioscope.plans import catalog
    from tests.harness import SF

    docs, claims = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    toks = [(r.item_id, r.toks) for r in claims.select("item_id", verify.content_tokens(F.col("text")).alias("toks")).collect() if len(r.toks) >= 3]
    want = set()
    for doc_id, corpus in docs.select("doc_id", F.lower("text")).collect():
        for item_id, ts in toks:
            share = sum(t in corpus for t in ts) / len(ts)
            if share >= 0.6:
                want.add((item_id, doc_id, round(share, 6)))
    got = [tuple(r) for r in catalog.queries()["claim_grounding_all"](spark, SF).select("item_id", "doc_id", "share").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(doc_id >= 200 for _, doc_id, _ in got)
    few = [tuple(r) for r in verify.grounded_pairs(docs, claims, block=7).withColumn("share", F.round("share", 6)).collect()]
    assert set(few) == want and len(few) == len(want)
    named = {tuple(r) for r in catalog.queries()["claim_grounding"](spark, SF).select("item_id", "doc_id", "share").collect()}
    assert named == want  # over all documents, no longer the first 200


def test_keyword_scores_and_verdicts_of_all_documents(spark):
    from folioscope.plans import catalog
    from tests.harness import SF

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert catalog.queries()["keyword_score_all"](spark, SF).count() == 4 * n
    assert catalog.queries()["claim_verification_all"](spark, SF).count() == n


def test_mmr_reads_all_candidates(spark):
    rng = np.random.default_rng(5)
    rows = []
    for query in (1, 2):
        best, others = rng.normal(size=8), rng.normal(size=(60, 8))
        vectors = np.vstack([np.repeat(best[None], 300, axis=0), others])
        relevance = np.concatenate([np.full(300, 0.9), rng.uniform(0.3, 0.8, 60)])
        rows += [(query, i, float(relevance[i]), vectors[i].tolist()) for i in range(len(vectors))]
    rows += [(3, i, 0.1 * i, rng.normal(size=8).tolist()) for i in range(5)]  # fewer than are chosen
    df = spark.createDataFrame(rows, "query_id long, id long, relevance double, embedding array<double>").repartition(7)
    got = {q: [] for q in (1, 2, 3)}
    for r in retrieval.mmr(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.relevance))
    for query, found in got.items():
        mine = [r for r in rows if r[0] == query]
        want = retrieval.mmr_order(np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 12, 0.7)
        assert found == want
    assert sum(i >= 300 for i, _ in got[1]) > 1
    assert retrieval.mmr(df.limit(0)).count() == 0


def test_survey_covers_every_label(spark):
    from folioscope.plans import catalog
    from tests.harness import SF

    sizes = {r.label: r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()}
    got = catalog.queries()["collection_survey_all"](spark, SF).collect()
    assert {(r.query_id, r.label): r.evidence for r in got} == {(q, x): min(8, n) for q in {r.query_id for r in got} for x, n in sizes.items()}


@pytest.mark.parametrize("name", ["latency_percentiles", "routing_recall", "claim_rows"])
def test_groups_are_not_collected_into_arrays(spark, name):
    from folioscope.plans import catalog
    from tests.harness import SF

    assert "collect_list" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()


def test_percentiles_and_recall_by_hand(spark):
    from folioscope.operators import review

    runs = [("a", float(x)) for x in [5, 1, 1, 1, 9, 2, 2, 7, 3, 3]] + [("b", 4.0), ("b", None), (None, 6.0), ("c", None)]
    got = {r.k: (r.p50, r.p95) for r in review.latency_percentiles(spark.createDataFrame(runs, "k string, seconds double"), "k").collect()}
    assert got == {"a": (3.0, 9.0), "b": (4.0, 4.0), None: (6.0, 6.0), "c": (None, None)}
    found = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1), ("z", 9)], "query_id string, doc_id int")
    gold = spark.createDataFrame([("x", 2), ("x", 3), ("z", 1)], "query_id string, doc_id int")
    assert {r.query_id: r.recall for r in verify.routing_recall(found, gold).collect()} == {"x": 0.5, "y": 1.0, "z": 0.0}


@pytest.mark.parametrize("by", [None, "kind"])
def test_blocked_search_equals_brute_force(spark, monkeypatch, by):
    """Several blocks on both sides, ties over them, groups with null, and vectors that take no part."""
    for name, size in (("QUESTION_BLOCK", 7), ("GROUPED_BLOCK", 7), ("ROW_BLOCK", 40), ("SCORES", 100)):
        monkeypatch.setattr(retrieval, name, size)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, size=(150, 4)).astype(float).tolist() + [[1.0, 2.0, 0.0, 1.0]] * 60
    rows = [(i, [None, "a", "b"][i % 3], v) for i, v in enumerate(vectors)]
    odd = [(900, "a", None), (901, "a", [1.0, None, 0.0, 0.0]), (902, "b", [float("nan"), 1.0, 0.0, 0.0]), (903, "b", [1.0]), (None, "a", [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "id long, kind string, embedding array<double>")
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(0, 210, 10)] + [(-1, None)], "query_id long, query_vector array<double>")

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 9) if size else 0.0

    want = set()
    for query in range(0, 210, 10):
        for kind in ([None, "a", "b"] if by else [...]):
            scored = sorted((-cosine(vectors[query], v), i) for i, k, v in rows if kind is ... or k == kind)
            want |= {(query, i, rank) for rank, (_, i) in enumerate(scored[:5], 1)}
    got = retrieval.dense_top(df, asked, 5, "id", by).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want and len(got) == len(want)
    assert retrieval.dense_top(df.limit(0), asked, 5, "id", by).count() == 0
    assert retrieval.dense_top(df, asked.limit(0), 5, "id", by).count() == 0


def test_grid_answers(spark):
    rows = [
        (1, '{"status": "FOUND", "value": 5, "quote": "null", "risk": "odd", "note": "n"}', 1, False), (2, '{"status": "found", "value": "x", "note": "n"}', 0, False),
        (3, '```json\n{"value": "x"}\n```', 2, False), (4, '{"a": {"b": ["x", null, "x", {"c": "y"}], "d": ""}}', 1, False), (5, '{"a": "None of it"}', 1, False), (6, '{"a": 1', 1, False),
        (7, '{"a": 1} and {"b": 2}', 1, False), (8, None, None, True), (9, "", 0, None), (10, "[1, 2]", 1, False), (11, "{}", 1, False), (12, '{"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}', 1, False),
    ]
    got = {r.id: r for r in verify.grid_cells(spark.createDataFrame(rows, "id int, answer string, n_sources int, degraded boolean")).collect()}
    told = {i: (r.status, r.value, r.quote, r.risk, r.note, r.abstain_reason) for i, r in got.items()}
    assert told == {
        1: ("found", "5", None, "none", "n", None), 2: ("abstain", None, None, "none", "n | claimed found but no source span grounded it", "no_evidence"),
        3: ("abstain", "x", None, "none", None, "ambiguous"), 4: ("found", "x; y", None, "none", "parse: recovered from another shape", None),
        5: ("abstain", None, None, "none", "None of it", "ambiguous"), 6: ("abstain", None, None, "none", 'parse: {"a": 1', "unparsed"),
        7: ("abstain", None, None, "none", 'parse: {"a": 1} and {"b": 2}', "unparsed"), 8: ("error", None, None, "none", "the run degraded", None),
        9: ("abstain", None, None, "none", "parse: no parseable answer", "unparsed"), 10: ("abstain", None, None, "none", "parse: [1, 2]", "unparsed"),
        11: ("abstain", None, None, "none", "parse: {}", "unparsed"), 12: ("abstain", None, None, "none", 'parse: {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}', "unparsed"),
    }
    assert "answer" in verify.grid_cells(spark.createDataFrame(rows[:0], "id int, answer string, n_sources int, degraded boolean")).columns
