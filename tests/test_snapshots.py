"""Snapshots of chunk tables: upserts, tenants, failures, conflicts, growth."""

import os

import pytest
from pyspark.sql import functions as F

from folioscope.sources import snapshots

SCHEMA = "namespace string, doc_id long, chunk_index int, text string"


def table(spark, path, **given):
    return {(r.namespace, r.doc_id, r.chunk_index): r.text for r in snapshots.read_snapshot(spark, path, **given).collect()}


def test_upserts_by_key_and_tenants_stay_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("001", 1, 0, "a"), ("1", 1, 0, "z"), ("2024-01-01", 1, 0, "d"), (None, 1, 0, "n"), ("1", None, None, "k"), ("1", 1, 0, "zz"), ("1", 1, 0, "z")]
    assert snapshots.save_snapshot(spark.createDataFrame(first, SCHEMA), path) == 1
    was = {("001", 1, 0): "a", ("1", 1, 0): "z", ("2024-01-01", 1, 0): "d", (None, 1, 0): "n", ("1", None, None): "k"}
    assert table(spark, path) == was
    assert snapshots.save_snapshot(spark.createDataFrame([("001", 1, 0, "b"), ("001", 2, 0, "c"), ("1", None, None, None), (None, 1, 0, "m")], SCHEMA), path) == 2
    now = was | {("001", 1, 0): "b", ("001", 2, 0): "c", ("1", None, None): None, (None, 1, 0): "m"}
    assert table(spark, path) == now and table(spark, path, snapshot=1) == was
    assert table(spark, path, namespaces=["001"]) == {k: v for k, v in now.items() if k[0] == "001"}
    assert table(spark, path, namespaces=[None]) == {(None, 1, 0): "m"}
    untouched = [next(f["file"] for f in snapshots.manifest(path, n)["files"] if f["namespace"] == "2024-01-01") for n in (1, 2)]
    assert untouched[0] == untouched[1]
    assert snapshots.save_snapshot(spark.createDataFrame([], SCHEMA), path) == 3 and table(spark, path) == now
    assert snapshots.vacuum(path) > 0 and table(spark, path) == now and snapshots.vacuum(path) == 0
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, path, snapshot=1)


def test_a_failed_job_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4000).select(F.concat(F.lit("n"), F.col("id") % 5).alias("namespace"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("text"))
    snapshots.save_snapshot(rows, path)
    broken = rows.withColumn("text", F.when(F.col("doc_id") == 3999, F.raise_error(F.lit("broken row")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="broken row"):
        snapshots.save_snapshot(broken, path)
    got = table(spark, path)
    assert len(got) == 4000 and set(got.values()) == {"old"} and snapshots.manifest(path)["number"] == 1
    assert sorted(os.listdir(tmp_path / "t" / "manifests")) == ["snapshot-00000001.json"]
    assert snapshots.save_snapshot(rows.withColumn("text", F.lit("new")), path) == 2 and set(table(spark, path).values()) == {"new"}
    snapshots.vacuum(path)
    assert sorted(os.listdir(tmp_path / "t" / "data")) == sorted(f["file"] for f in snapshots.manifest(path)["files"])


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 0, "x")], SCHEMA)
    snapshots.save_snapshot(rows, path)
    real = snapshots.manifest
    monkeypatch.setattr(snapshots, "manifest", lambda p, s=None: real(p, s) | {"number": 0, "files": []})  # began before the first
    with pytest.raises(Exception, match="meanwhile"):
        snapshots.save_snapshot(rows.withColumn("text", F.lit("y")), path)
    monkeypatch.undo()
    assert len(os.listdir(tmp_path / "t" / "data")) == 1
    assert table(spark, path) == {("a", 1, 0): "x"}


def test_growing_tenants_are_split_and_columns_may_come_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 20)
    path = str(tmp_path / "t")
    rows = lambda lo, hi, text: spark.range(lo, hi).select(F.lit("big").alias("namespace"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit(text).alias("text"))
    snapshots.save_snapshot(rows(0, 60, "a"), path)
    assert dict(map(tuple, snapshots.manifest(path)["buckets"])) == {"big": 3}
    snapshots.save_snapshot(rows(50, 400, "b").withColumn("page", F.lit(7)), path)
    assert dict(map(tuple, snapshots.manifest(path)["buckets"])) == {"big": 21}
    got = snapshots.read_snapshot(spark, path).collect()
    assert {(r.doc_id, r.text, r.page) for r in got} == {(i, "a", None) if i < 50 else (i, "b", 7) for i in range(400)} and len(got) == 400
    snapshots.save_snapshot(rows(0, 1, "c"), path)
    assert {(r.doc_id, r.text) for r in snapshots.read_snapshot(spark, path).where("doc_id < 2").collect()} == {(0, "c"), (1, "a")}


def test_equal_texts_get_one_vector(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("a", 2, 0, "same"), ("a", 1, 1, "same"), ("b", 9, 0, "same"), ("a", 3, 0, None), ("a", 4, 0, "")]
    snapshots.embed_and_save(spark.createDataFrame(rows, SCHEMA), path)
    got = {(r.namespace, r.doc_id): r.embedding for r in snapshots.read_snapshot(spark, path).collect()}
    assert got.keys() == {("a", 1), ("b", 9), ("a", 3)} and got["a", 1] == got["b", 9] and all(got.values())
