"""The life of queued jobs as a stream: claims, results, timed retries and the reaper as keyed state with timers.

The state of a job is one small row; what time alone brings about (a retry falls due, a run is overdue) is a timer in
event time. An event first brings its job up to its own time, so that the changes are the same whether a timer or the
next event comes first, however the events are cut into micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from planwright.session import work_dir

#: Attempts before a job has failed for good, and the seconds that 2 to the attempts is multiplied by.
MAX_ATTEMPTS, BACKOFF_S = 3, 2
CHANGES = "job_id bigint, at_us bigint, change string, status string, attempts int"
STATE = "status string, attempts int, started bigint, due bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: tuple, now: int, timeout_us: int) -> tuple[tuple, list[tuple]]:
    """The state (status, attempts, started, due) at `now`, and the changes (at, change, status, attempts) until then."""
    status, attempts, started, due = state
    if status == "RUNNING" and started + timeout_us < now:
        at = started + timeout_us
        if attempts < MAX_ATTEMPTS:
            return ("QUEUED", attempts, None, None), [(at, "reaped", "QUEUED", attempts)]
        return ("FAILED", attempts, None, None), [(at, "timeout", "FAILED", attempts)]
    if status == "QUEUED" and due is not None and due <= now:
        return ("QUEUED", attempts, None, None), [(due, "released", "QUEUED", attempts)]
    return state, []


def apply(state: tuple, at: int, event: str, timeout_us: int) -> tuple[tuple, list[tuple]]:
    """The state after an event (enqueue, claim, done or error) at `at`, with all changes; an event that does not fit changes nothing."""
    state, made = advance(state, at, timeout_us)
    status, attempts, _, due = state
    change = None
    if event == "enqueue" and status in (None, "DONE", "FAILED"):
        state, change = ("QUEUED", 0, None, None), "queued"
    elif event == "claim" and status == "QUEUED" and due is None:
        state, change = ("RUNNING", attempts + 1, at, None), "claimed"
    elif event == "done" and status == "RUNNING":
        state, change = ("DONE", attempts, None, None), "done"
    elif event == "error" and status == "RUNNING":
        if attempts >= MAX_ATTEMPTS:
            state, change = ("FAILED", attempts, None, None), "failed"
        else:
            state, change = ("QUEUED", attempts, None, at + 2**attempts * BACKOFF_S * 1_000_000), "retry"
    return state, made + ([(at, change, state[0], state[1])] if change else [])


def timer_ms(state: tuple, timeout_us: int) -> int | None:
    """When time alone changes the state next."""
    status, _, started, due = state
    if status == "RUNNING":
        return (started + timeout_us) // 1000 + 1
    return -(-due // 1000) if status == "QUEUED" and due is not None else None


def _frame(job_id: int, made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(job_id, *m) for m in made], columns=["job_id", "at_us", "change", "status", "attempts"])


class Lifecycle(StatefulProcessor):
    """Keyed by job. Rows of a job in one micro-batch are put in order of time, then of their number."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _get(self) -> tuple:
        held = self.state.get()
        return tuple(held) if held is not None else (None, 0, None, None)

    def _put(self, before: tuple, after: tuple) -> None:
        old, new = timer_ms(before, self.timeout_us), timer_ms(after, self.timeout_us)
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        if after[0] is not None:
            self.state.update(after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = state = self._get()
        events, made = pd.concat(list(rows)).sort_values(["at_us", "event_id"]), []
        for at, event in zip(events["at_us"].tolist(), events["event"].tolist(), strict=True):
            state, new = apply(state, at, event, self.timeout_us)
            made += new
        self._put(before, state)
        yield _frame(key[0], made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._get()
        state, made = advance(before, expiredTimerInfo.getExpiryTimeInMs() * 1000, self.timeout_us)
        after = timer_ms(state, self.timeout_us)
        if after is not None and made:
            self.handle.registerTimer(after)
        self.state.update(state)
        yield _frame(key[0], made)

    def close(self) -> None:
        pass


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, event, event_id, ts, at_us) of the events table: a user's lane is the job; sign-ups and purchases enqueue, a click claims, a view ends the run well."""
    event = F.when(F.col("event_type").isin("signup", "purchase"), "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "done").otherwise(F.col("event_type"))
    ts = F.col("ts").cast("timestamp")
    return events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("user_id").alias("job_id"), event.alias("event"), "event_id", ts.alias("ts"), F.unix_micros(ts).alias("at_us"))


def changes_stream(events: DataFrame, timeout_s: int, delay: str = "1 second") -> DataFrame:
    """All changes of the jobs of a stream of job_events(); the watermark trails the latest event by `delay`."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(Lifecycle(timeout_s * 1_000_000), CHANGES, "append", "EventTime")


def changes_batch(events: DataFrame, timeout_s: int, until_us: int) -> DataFrame:
    """The same changes of a finite table, with what time alone brings about before `until_us`."""
    timeout_us = timeout_s * 1_000_000

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, made = (None, 0, None, None), []
        rows = rows.sort_values(["at_us", "event_id"])
        for at, event in zip(rows["at_us"].tolist(), rows["event"].tolist(), strict=True):
            state, new = apply(state, at, event, timeout_us)
            made += new
        return _frame(key[0], made + advance(state, until_us, timeout_us)[1])

    return events.select("job_id", "event", "event_id", "at_us").groupBy("job_id").applyInPandas(fold, CHANGES)


def drain(spark: SparkSession, folder: str, run: str, timeout_s: int, files: int = 1) -> None:
    """Runs the stream over the files under `folder` that it has not seen, `files` a micro-batch; state and sink are under `run`.

    A run that was stopped goes on from its checkpoint: no change is lost or written twice.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        schema = "job_id bigint, event string, event_id bigint, ts timestamp, at_us bigint"
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
        made = changes_stream(events, timeout_s)
        made.writeStream.format("parquet").option("path", f"{run}/changes").option("checkpointLocation", f"{run}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def replayed(events: DataFrame, timeout_s: int, cuts: int = 3) -> DataFrame:
    """The changes of a table replayed as `cuts` files in order of time, one micro-batch each."""
    spark = events.sparkSession
    run = f"{work_dir(spark)}/lifecycle-{uuid.uuid4().hex}"
    rows = job_events(events)
    ends = rows.agg(F.min("at_us").alias("low"), F.max("at_us").alias("high")).head()
    if ends["low"] is None:
        return spark.createDataFrame([], CHANGES)
    step = (ends["high"] - ends["low"]) // cuts + 1
    for k in range(cuts):
        part = rows.where((F.col("at_us") >= ends["low"] + k * step) & (F.col("at_us") < ends["low"] + (k + 1) * step))
        part.coalesce(1).write.mode("append").parquet(f"{run}/events")
    drain(spark, f"{run}/events", run, timeout_s)
    return spark.read.schema(CHANGES).parquet(f"{run}/changes")
