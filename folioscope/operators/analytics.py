"""Usage analytics over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_summary(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Over the last days: queries, mean latency without nulls (1 decimal), shares of flags in percent.

    log: at, latency_ms, cache_hit, agentic, web.
    """
    recent = log.where(F.col("at") >= now - F.make_dt_interval(days=F.lit(days)))
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")) * 100, 1)
    day = F.to_date("at")
    return recent.agg(
        F.count("*").alias("queries"), F.round(F.avg("latency_ms"), 1).alias("avg_latency"), share("cache_hit").alias("cache_rate"), share("agentic").alias("agentic_rate"),
        share("web").alias("web_rate"), F.count_if(day == F.to_date(now)).alias("today"), F.count_if(day >= F.date_sub(F.to_date(now), 7)).alias("last_7_days"),
    )


def daily_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"))


def top_queries(log: DataFrame, k: int = 5, chars: int = 50) -> DataFrame:
    """The commonest prefixes; of equals the one used last."""
    per = log.groupBy(F.substring("query", 1, chars).alias("query")).agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return per.orderBy(F.desc("n"), F.desc("last_at"), "query").limit(k)


def page(log: DataFrame, number: int, per_page: int, order: list) -> DataFrame:
    """One page of rows, each with the exact total; ``per_page`` is 100 at most.  The total is one scalar, joined on."""
    size = min(per_page, 100)
    total = log.agg(F.count("*").alias("total"))
    return log.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def counts_with_zero(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.select(key).join(children.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])


def usage_cube(log: DataFrame, dims: list[str]) -> DataFrame:
    """Counts for all groupings of the dimensions; ``level`` tells which are summed over."""
    return log.cube(*dims).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def breaker_windows(calls: DataFrame, failures: int = 5, seconds: int = 60) -> DataFrame:
    """``trips``: whether a failure is the one that makes ``failures`` within the window before it."""
    span = Window.partitionBy("service").orderBy(F.col("at").cast("timestamp").cast("long")).rangeBetween(-(seconds - 1), 0)
    return calls.withColumn("recent_failures", F.count_if(~F.col("ok")).over(span)).withColumn("trips", ~F.col("ok") & (F.col("recent_failures") >= failures))


def first_messages(messages: DataFrame, chars: int = 60) -> DataFrame:
    """A title per conversation: the beginning of the first question."""
    asked = messages.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("m"))
    return asked.select("conv_id", F.substring("m.text", 1, chars).alias("title"))


def histogram(log: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """Counts of equal-width buckets 1..n, 0 below and n + 1 above."""
    return log.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(n)).alias("bucket")).agg(F.count("*").alias("n"))
