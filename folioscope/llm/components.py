"""Connected components of an edge table, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import fresh_path, remove


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b) that has an edge to another id; the component is named by its smallest id.

    Defined results: edges with a null end and edges from an id to itself count for nothing; repeated edges count once; without
    edges there are no rows; other columns are ignored.

    Each round maps every vertex to the smallest of itself and its neighbours and draws the edges anew between the
    mapped vertices; an edge whose ends fall together goes.  Every table is written to the shared folder, so that no
    lineage grows and lost executors cost one round at most; at the end all but the result are removed.
    """
    spark, written = edges.sparkSession, []

    def scratch(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        written.append(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = scratch(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, result = None, ""
    for _ in range(most_rounds):
        ends = edges.select(F.col("a").alias("v"), F.col("a").alias("m")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("m")))
        smallest = scratch(ends.groupBy("v").agg(F.min("m").alias("m")), "smallest")
        if labels is None:
            labels = smallest.select(F.col("v").alias("id"), F.col("m").alias("component"))
            result = written[-1]
        else:
            step = smallest.withColumnRenamed("v", "component")
            labels = scratch(labels.join(step, "component", "left").select("id", F.coalesce("m", "component").alias("component")), "labels")
            result = written[-1]
        by_a = smallest.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        by_b = smallest.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        drawn = edges.join(by_a, "a").join(by_b, "b").where(F.col("ma") != F.col("mb"))
        edges = scratch(drawn.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            for path in written:
                if path != result:
                    remove(spark, path)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
