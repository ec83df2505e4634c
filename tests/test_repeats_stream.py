"""Repeated calls over a stream: out of order, in several files, across restarts and pauses, equal to the batch form; old state goes."""

import random

from folioscope.streaming import events

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KIND = "run_id long, signature string, at double, event_id long, ok boolean, note string"


def brute(calls, most, idle):
    seen, out = {}, []
    for run, sig, at, event, ok, _ in sorted(calls, key=lambda c: (c[2], c[3])):
        failures, last = seen.get((run, sig), (0, at))
        failures = 0 if at - last >= idle else failures
        out.append((run, sig, at, event, ok, failures >= most))
        seen[run, sig] = failures + (not ok), at
    return sorted(out)


def sample(rng):
    return [(run, sig, 1000.0 + rng.randrange(900), run * 1000 + i, rng.random() < 0.5, "n") for run in range(2) for i in range(60) for sig in [rng.choice("ab")]]


def test_batch_equals_brute_force_with_ties_and_nulls(spark):
    calls = sample(random.Random(1))
    odd = [(None, "a", 1.0, 1, True, "n"), (1, None, 1.0, 1, True, "n"), (1, "a", None, 1, True, "n"), (1, "a", 1.0, 1, None, "n"), (1, "a", 1.0, None, True, "n")]
    rows = spark.createDataFrame(calls + odd, KIND)
    for idle in (20, 100, 10_000):
        assert sorted(map(tuple, events.repeats_blocked(rows, 2, idle).collect())) == brute(calls, 2, idle)
    assert events.repeats_blocked(rows.where("false")).count() == 0


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    rng = random.Random(5)
    calls = sample(rng)
    files = sorted(calls, key=lambda c: c[2] + rng.uniform(-40, 40))  # out of order by less than the delay
    files = [files[i : i + 30] for i in range(0, len(files), 30)]
    source, sink, log = f"{tmp_path}/calls", f"{tmp_path}/answers", f"{tmp_path}/log"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    last = (9, "z", 9000.0, 1, True, "n")
    parts = [files[:2], files[2:], [[last]], [[(0, "a", 1001.0, 7, False, "late"), (9, "z", 9900.0, 2, True, "n")]]]
    try:
        for part in parts:
            for f in part:
                spark.createDataFrame(f, KIND).coalesce(1).write.mode("append").parquet(source)
            stream = events.repeats_blocked(events.read_stream(spark, source, KIND, 1), 2, 50, "100 seconds")
            query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(150)
            assert query.exception() is None
        kept = spark.read.format("statestore").option("stateVarName", "state").load(log).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).where("run_id < 9").select("run_id", "signature", "at", "event_id", "ok", "blocked").collect())
    assert got == brute(calls, 2, 50) and {r[5] for r in got} == {True, False}
    assert {r.key.run_id for r in kept} <= {9}
