"""Windows, sessions, dedup and circuit state over streams of events (event_id, ts, user_id, event_type, value).

Event time is ``ts``; rows later than the watermark are dropped.  The functions take batch tables as well, where the
watermark has no effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def tumbling_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    per = timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    per = timed(events).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    per = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return per.select(F.col("session_window.start").alias("start"), "user_id", "n")


def daily_dedup(events: DataFrame) -> DataFrame:
    """One row per user, type and day."""
    keyed = timed(events).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    if events.isStreaming:
        return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")
    return keyed.select("user_id", "event_type", "day").distinct()


BREAKER_STATE = "failures array<double>, state string, opened_at double, successes int"
BREAKER_OUT = "service long, at double, ok boolean, state string"


def breaker_step(state: tuple, at: float, ok: bool, most: int, span: float, cooldown: float, needed: int) -> tuple:
    """The state after a call: closed, open or half_open.

    ``most`` failures within ``span`` seconds open the circuit; after ``cooldown`` seconds it is half open and lets every
    call through; ``needed`` successes close it, and a failure opens it again.
    """
    failures, name, opened_at, successes = state
    if name == "open" and at - opened_at >= cooldown:
        name, successes = "half_open", 0
    if ok:
        successes += 1
        if name == "half_open" and successes >= needed:
            failures, name, successes = [], "closed", 0
    else:
        successes = 0
        failures = [f for f in failures if at - f < span] + [at]
        if name == "half_open" or (name == "closed" and len(failures) >= most):
            name, opened_at = "open", at
    return failures, name, opened_at, successes


def breaker(calls: DataFrame, most: int = 5, span: float = 60, cooldown: float = 30, needed: int = 2) -> DataFrame:
    """The circuit's state after each call (service, at in seconds, ok); on streams it is kept between batches."""
    start = ([], "closed", 0.0, 0)

    def run(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        names = []
        rows = rows.sort_values("at")
        for at, ok in zip(rows["at"], rows["ok"]):
            state = breaker_step(state, float(at), bool(ok), most, span, cooldown, needed)
            names.append(state[1])
        return rows.assign(state=names)[["service", "at", "ok", "state"]], state

    def update(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = group.get if group.exists else start
        state = (list(state[0]), *state[1:])
        rows = pd.concat(list(batches))
        if len(rows):
            out, state = run(rows, state)
            group.update((list(map(float, state[0])), state[1], float(state[2]), int(state[3])))
            yield out

    grouped = calls.select("service", "at", "ok").groupBy("service")
    if calls.isStreaming:
        return grouped.applyInPandasWithState(update, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout)
    return grouped.applyInPandas(lambda rows: run(rows, start)[0], BREAKER_OUT)


class InOrder(StatefulProcessor):
    """Calls of a key wait until the watermark has passed them, and are then answered in the order of their fields, time first.

    A timer stands at the earliest call that waits; where none waits, at the time from which the key's state says no more than
    none (``stale_at``), when it is removed: keys that are not heard of again leave nothing behind.
    """

    fields: tuple[str, ...] = ()
    kinds = state_kind = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_kind)
        self.waiting = handle.getListState("waiting", self.kinds)

    def wake(self, at: float) -> None:
        """A timer at this time unless an earlier one stands."""
        due = math.ceil(at * 1000)
        timers = list(self.handle.listTimers())
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                self.waiting.appendList([tuple(map(plain, call)) for call in zip(*(batch[f] for f in self.fields))])
                self.wake(float(batch["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        calls = sorted(tuple(c) for c in self.waiting.get())
        due, rest = [c for c in calls if c[0] <= passed], [c for c in calls if c[0] > passed]
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for call in due:
            state, said = self.answer(state, call)
            out.append((*key, *call, said))
        stale = None if state is None else self.stale_at(state)
        if stale is not None and stale <= passed:
            state = None
        if state is None:
            self.state.clear()
        elif due:
            self.state.update(state)
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        nexts = [c[0] for c in rest[:1]] + ([stale] if state is not None and stale is not None else [])
        if nexts:
            self.handle.registerTimer(math.ceil(min(nexts) * 1000))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def plain(value):
    """A Python value of a numpy one."""
    return value.item() if hasattr(value, "item") else value


class Circuit(InOrder):
    """``breaker_step`` of each call; a closed circuit without a failure within the span is as good as a new one."""

    fields, kinds, state_kind = ("at", "ok"), "at double, ok boolean", BREAKER_STATE
    columns = ["service", "at", "ok", "state"]

    def __init__(self, most: int, span: float, cooldown: float, needed: int):
        self.rules = (most, span, cooldown, needed)

    def answer(self, state, call):
        failures, *others = state or ([], "closed", 0.0, 0)
        failures, name, opened_at, successes = breaker_step((list(failures), *others), *call, *self.rules)
        return (list(map(float, failures)), name, float(opened_at), int(successes)), name

    def stale_at(self, state) -> float | None:
        return max(state[0], default=-math.inf) + self.rules[1] if state[1] == "closed" else None


def breaker_in_order(calls: DataFrame, delay: str = WATERMARK, most: int = 5, span: float = 60, cooldown: float = 30, needed: int = 2) -> DataFrame:
    """``breaker`` of a stream whose calls (service, at, ok) come in any order within ``delay``: the rows are those of the batch
    form, however calls are dealt over micro-batches and restarts; calls of one time go failures first.  A call is answered once
    the watermark has passed it, and one that comes later than that is dropped.

    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    at = F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))
    timely = calls.where("service is not null and at is not null and ok is not null").select("service", "at", "ok", at.alias("ts")).withWatermark("ts", delay)
    return timely.groupBy("service").transformWithStateInPandas(Circuit(most, span, cooldown, needed), BREAKER_OUT, "Append", "EventTime")


class Repeats(InOrder):
    """Failures of a call since the last pause of ``idle`` seconds; after one, nothing is known of the call."""

    fields, kinds, state_kind = ("at", "event_id", "ok"), "at double, event_id long, ok boolean", "failures int, last double"
    columns = ["run_id", "signature", "at", "event_id", "ok", "blocked"]

    def __init__(self, most: int, idle: float):
        self.most, self.idle = most, idle

    def answer(self, state, call):
        failures, last = state or (0, call[0])
        failures = 0 if call[0] - last >= self.idle else failures
        return (int(failures + (not call[2])), float(call[0])), failures >= self.most

    def stale_at(self, state) -> float:
        return state[1] + self.idle


def repeats_blocked(calls: DataFrame, most: int = 2, idle: float = 3600, delay: str = WATERMARK) -> DataFrame:
    """(run_id, signature, at, event_id, ok, blocked): whether the same call (run_id, signature) has failed ``most`` times before in
    its run, since the last pause of at least ``idle`` seconds between two such calls; ``at`` in seconds, ties by ``event_id``.

    Calls without one of these fields are left out.  On streams a call is answered once the watermark has passed it, so the rows
    are those of the batch form in whatever order calls come within ``delay``; a call later than that is dropped, and the state of
    a call is removed once the watermark has passed its pause.  Streams need the RocksDB state store.
    """
    names = ["run_id", "signature", "at", "event_id", "ok"]
    whole = calls.select(*names).dropna()
    if calls.isStreaming:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
        timely = whole.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", delay)
        return timely.groupBy("run_id", "signature").transformWithStateInPandas(Repeats(most, idle), f"{kinds}, blocked boolean", "Append", "EventTime")
    here = Window.partitionBy("run_id", "signature").orderBy("at", "event_id")
    paused = F.coalesce(F.col("at") - F.lag("at").over(here) >= idle, F.lit(False))
    spells = whole.withColumn("spell", F.sum(paused.cast("int")).over(here))
    before = Window.partitionBy("run_id", "signature", "spell").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return spells.select(*names, (F.coalesce(F.count_if(~F.col("ok")).over(before), F.lit(0)) >= most).alias("blocked"))
