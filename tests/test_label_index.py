"""Labels met by an index equal labels met one by one, and no plan compares all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import kernel

BASE = ["Net sales", "sales", "Total net sales", "e", "", None, "Cost of sales", "Net  Sales", "(net) sales", "Operating income", "income", "perating", "abcab", "bcab", "Sales, total", "revénue", "Revenue"]


def labels(n, seed):
    rng = random.Random(seed)
    out = list(BASE)
    for _ in range(n):
        w = list(rng.choice([b for b in BASE if b]))
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 2)] = rng.choice(["", "x", "al", " "])
        out.append("".join(w))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    have = spark.createDataFrame([(x,) for x in labels(60, 1)], "label string")
    want = spark.createDataFrame([(x,) for x in labels(30, 2)], "want_label string")
    return have, want


def test_fitting_labels_equal_all_pairs(spark, tables):
    have, want = tables
    got = {tuple(r) for r in kernel.fitting_labels(have, want).collect()}
    every = have.crossJoin(want).withColumn("fit", kernel.label_fit(F.col("label"), F.col("want_label"))).where("fit > 0")
    assert got == {tuple(r) for r in every.select(kernel.normal_label(F.col("label")), kernel.normal_label(F.col("want_label")), "fit").distinct().collect()}


@pytest.mark.parametrize("cutoff", [0.5, 0.8])
def test_close_labels_equal_all_pairs(spark, tables, cutoff):
    have, want = tables
    want = want.withColumnRenamed("want_label", "want")
    got = {(r.want, r.label, round(r.likeness, 9)) for r in kernel.close_labels(have, want, 10**6, cutoff).collect()}
    a, b = kernel.normal_label(F.col("label")), kernel.normal_label(F.col("want"))
    likeness = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    every = have.distinct().crossJoin(want.distinct()).withColumn("likeness", likeness).where(F.col("likeness") >= cutoff)
    assert got == {(r.want, r.label, round(r.likeness, 9)) for r in every.collect()}


def test_no_plan_compares_all_pairs(spark, tables):
    have, want = tables
    cells = have.selectExpr("'d' as doc", "'t' as table_id", "length(label) as row_ix", "'' as section", "label", "concat('20', length(label)) as period", "'5' as raw")
    metrics = want.selectExpr("want_label as metric_id", "want_label", "concat('20', length(want_label)) as want_period")
    refs = metrics.selectExpr("metric_id as ref_id", "'' as want_section", "want_label", "want_period")
    for df in (kernel.close_labels(have, want.withColumnRenamed("want_label", "want")), kernel.find_rows(cells, refs), kernel.scored_cells(cells, metrics)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
