"""The circuit over calls that come out of order, in several files and across restarts, equals the batch form."""

import random

from folioscope.streaming import events

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KIND = "service long, at double, ok boolean"


def test_calls_out_of_order_equal_the_batch(spark, tmp_path):
    rng = random.Random(7)
    calls = [(s, 1000.0 + t + s / 10, rng.random() < 0.4) for s in range(3) for t in sorted(rng.sample(range(600), 80))]
    want = sorted(tuple(r) for r in events.breaker(spark.createDataFrame(calls, KIND), 3, 60, 30, 2).collect())
    calls.sort(key=lambda c: c[1] + rng.uniform(-40, 40))  # out of order by less than the delay
    files = [calls[i : i + 40] for i in range(0, len(calls), 40)]
    source, sink = f"{tmp_path}/calls", f"{tmp_path}/states"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        parts = [files[:2], files[2:], [[(9, 9000.0, True)]], [[(0, 1001.0, False), (9, 9900.0, True)]]]  # the third lets all pass, a call of the fourth is too late
        for part in parts:
            for f in part:
                spark.createDataFrame(f, KIND).coalesce(1).write.mode("append").parquet(source)
            stream = events.breaker_in_order(events.read_stream(spark, source, KIND, 1), "100 seconds", 3, 60, 30, 2)
            query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(150)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).where("service < 9").select("service", "at", "ok", "state").collect())
    assert got == want and {r[3] for r in got} == {"closed", "open", "half_open"}
