"""Results that must not depend on how many rows, copies or equal questions there are."""

import os
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from folioscope.operators import govern, retrieval, verify
from folioscope.plans import catalog
from tests.harness import compare


def tables(folder, **columns) -> str:
    for name, table in columns.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


def duck_of(folder):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{folder}/{file}')")
    return con


def vectors(rows) -> pa.Table:
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[0] % 10 for r in rows], pa.int32())})


def test_questions_with_several_equal_vectors_are_not_graded_weak(spark, tmp_path):
    sf = tables(tmp_path, embeddings=vectors([(i, [1.0, 0.0] if i % 20 == 0 else [0.0, 1.0 + i]) for i in range(100)]))
    assert compare(spark, duck_of(tmp_path), sf, catalog.queries()["empty_grades"], catalog.oracle_sql()["empty_grades"]) == ""


def plan_rows(df) -> int:
    """The most rows that a step of the plan puts out."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        return max([rows.get().value() if rows.isDefined() else 0, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def shuffled_bytes(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_equal_questions_look_their_words_up_once(spark):
    docs = spark.range(300).selectExpr("id", "concat('common w', id) as text")
    asked = spark.range(200).selectExpr("id as query_id", "if(id % 2 = 0, 'common w5', 'W7 common w7') as query")
    got = retrieval.keyword_relevance(docs, asked, 2)
    assert {tuple(r) for r in got.collect()} == {(q, i, s) for q in range(200) for i, s in ([(5, 1.0), (0, 0.5)] if q % 2 == 0 else [(7, 1.0), (0, 0.5)])}
    assert plan_rows(got) < 10_000  # before, 200 questions x 300 documents


def test_offers_of_a_diverse_search_leave_their_vectors_at_home(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 97)
    drawn = np.random.default_rng(5).normal(size=(776, 512))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)], "id long, embedding array<float>")
    asked = rows.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a task for each block
    try:
        got = retrieval.diverse_top(rows, asked, 3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert shuffled_bytes(spark) - before < 30_000_000  # not the blocks times 40 questions times 97 offers of 4096 bytes
    vectors = drawn.astype(np.float32).astype(np.float64)
    sizes = np.linalg.norm(vectors, axis=1)
    for q in (0, 17, 39):
        relevance = np.round(vectors @ vectors[q] / (sizes * sizes[q]), 12)
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i, _ in retrieval.mmr_order(np.arange(776), relevance, vectors, 3, 0.7)]


def test_what_partners_see_is_not_shuffled_pair_by_pair(spark):
    vaults = spark.range(4000).selectExpr("id as vault_id", "id % 4 as firm_id", "id % 50 as owner_id")
    members = spark.range(400).selectExpr("id as user_id", "id % 4 as firm_id", "if(id < 390, 'partner', 'associate') as role")
    staffed = spark.range(4000).selectExpr("id % 400 as user_id", "id as vault_id")
    screens = spark.range(4000).selectExpr("id % 400 as user_id", "id as vault_id", "if(id % 3 = 0, 'x', null) as removed_at")
    before = shuffled_bytes(spark)
    got = govern.visible(vaults, members, staffed, screens)
    n = got.count()
    assert shuffled_bytes(spark) - before < 2_200_000  # 390,000 pairs are more
    assert n == got.distinct().count() == brute_visible(vaults, members, staffed, screens)[0]


def test_visible_with_repeats_nulls_and_vaults_of_several_firms(spark):
    vaults = spark.createDataFrame([(1, 1, 7), (1, 1, 7), (1, 2, 1), (2, 1, 1), (2, None, 9), (3, 1, 3), (None, 1, 1), (None, 2, 5), (4, None, 4), (5, 2, 2)], "vault_id int, firm_id int, owner_id int")
    members = spark.createDataFrame([(1, 1, "partner"), (1, 1, "partner"), (2, 2, "partner"), (1, 2, "senior_partner"), (3, 1, "associate"), (4, 2, "associate"), (None, 1, "partner"), (9, None, "partner")], "user_id int, firm_id int, role string")
    staffed = spark.createDataFrame([(3, 1), (3, 1), (4, 1), (4, 3), (1, 5), (None, 1)], "user_id int, vault_id int")
    screens = spark.createDataFrame([(1, 1, None), (1, 1, None), (2, 5, "2024"), (3, 3, None), (None, 3, None)], "user_id int, vault_id int, removed_at string")
    got = govern.visible(vaults, members, staffed, screens).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_visible(vaults, members, staffed, screens)[1]))


def test_what_partners_see_takes_little_disk(spark, tmp_path):
    vaults = spark.range(2000).selectExpr("id as vault_id", "id % 4 as firm_id", "id % 50 as owner_id")
    members = spark.range(8000).selectExpr("id as user_id", "id % 4 as firm_id", "'partner' as role")
    nothing = spark.createDataFrame([], "user_id long, vault_id long, removed_at string")
    govern.visible(vaults, members, nothing.drop("removed_at"), nothing).write.parquet(f"{tmp_path}/seen")
    files = list((tmp_path / "seen").glob("*.parquet"))
    rows = sum(pq.read_metadata(f).num_rows for f in files)
    assert rows >= 4_000_000 and sum(f.stat().st_size for f in files) < 0.3 * rows  # before, 0.56 bytes for a row


def test_blocks_of_vaults_and_partners_lose_and_repeat_nothing(spark, monkeypatch):
    for name, n in (("LEFT_BLOCK", 40), ("RIGHT_BLOCK", 15), ("LEFT_PIECE", 7), ("RIGHT_PIECE", 4)):
        monkeypatch.setattr(govern, name, n)
    vaults = spark.range(900).selectExpr("if(id = 5, null, id) as vault_id", "if(id % 3 = 0, 0, id % 5) as firm_id", "id % 50 as owner_id")
    members = spark.range(300).selectExpr("if(id = 7, null, id) as user_id", "if(id % 2 = 0, 0, id % 6) as firm_id", "if(id % 5 = 0, 'associate', 'partner') as role")
    staffed = spark.range(900).selectExpr("id % 300 as user_id", "id as vault_id")
    screens = spark.range(900).selectExpr("id % 90 as user_id", "id as vault_id", "if(id % 3 = 0, 'x', null) as removed_at")
    got = [tuple(r) for r in govern.visible(vaults, members, staffed, screens).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_visible(vaults, members, staffed, screens)[1]


def brute_visible(vaults, members, staffed, screens):
    v, m, s = ([tuple(r) for r in df.collect()] for df in (vaults, members, staffed))
    firms = {}
    for user, firm, role in m:
        firms.setdefault(firm, set()).add((user, role != "associate"))
    known = {u for u, *_ in m} - {None}
    member = {(u, f) for u, f, _ in m if u is not None and f is not None}
    seen = {(u, vault) for vault, firm, _ in v if firm is not None for u, leads in firms.get(firm, ()) if leads}
    seen |= {(owner, vault) for vault, _, owner in v if owner in known}
    of = {}
    for vault, firm, _ in v:
        of.setdefault(vault, set()).add(firm)
    seen |= {(u, vault) for u, vault in s if vault is not None and any((u, f) in member for f in of.get(vault, ()))}
    seen -= {(r.user_id, r.vault_id) for r in screens.collect() if r.removed_at is None and r.user_id is not None and r.vault_id is not None}
    return len(seen), seen


def test_a_block_of_questions_and_rows_takes_little_memory(spark):
    rows = spark.createDataFrame([], "id long, embedding array<float>")
    asked = spark.createDataFrame([], "query_id long, query_vector array<float>")
    solve, _ = retrieval.block_best(rows, asked, 8, "id", None)
    drawn = np.random.default_rng(3).normal(size=(16_384, 8)).astype(np.float32)
    right, left = pd.DataFrame({"id": np.arange(16_384), "v": list(drawn)}), pd.DataFrame({"query_id": np.arange(512), "v": list(drawn[:512])})
    tracemalloc.start()
    try:
        found = solve(left, right)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70_000_000 and len(found) == 512 * 8
    assert (found.groupby("query_id")["id"].first() == np.arange(512)).all()


def test_a_text_is_lowered_once_for_all_mentions(spark):
    assert str(verify.addressed(F.col("a"), F.col("b"))).count("lower(") == 2
