"""Jobs that finish in time and jobs that run out of it, from a stream of status events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from tidemill.operators.jobs import MAX_RUNTIME_HOURS

STATE = StructType([StructField("started", LongType()), StructField("ended", BooleanType())])
OUTPUT = "job_id string, outcome string, started_ms bigint, ended_ms bigint"
# Timers and the Python state interface need this state store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SLOT = "1 minute"
#: Jobs are dealt into so many states by their hash; a checkpoint keeps the number it began with.
BUCKETS = 2048
BUCKET_STATE = StructType([StructField("jobs", BinaryType()), StructField("due", LongType())])
JOBS = pa.schema([("job_id", pa.string()), ("started", pa.int64()), ("ended", pa.int64())])
HOUR_MS = 3600 * 1000
REMEMBER_HOURS = 7 * 24


class Deadline(StatefulProcessor):
    """Per job: the start time, and a timer for the longest allowed run.

    Rows arrive per slot of time and in no particular order within a batch. Rows up to a
    watermark are handed over before the timers up to it fire, so the outcome does not
    depend on how the stream was cut into batches. A job that has ended is remembered for
    a while, so that its last events do not start it again, and then forgotten.
    """

    def __init__(self, limit_ms: int, remember_ms: int | None) -> None:
        self.limit_ms = limit_ms
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        slots = [(r["first_ms"], r["done_ms"]) for r in rows]
        state = self.job.get()
        if state is not None and state[1]:
            return
        known = None if state is None else state[0]
        start = min(first for first, _ in slots)
        if known is not None:
            start = min(start, known)
        done = min((d for _, d in slots if d is not None), default=None)
        if done is not None and done <= start + self.limit_ms:
            if known is not None:
                self.handle.deleteTimer(known + self.limit_ms)
            yield self._end(key, "finished", start, done)
        elif known != start:
            if known is not None:
                self.handle.deleteTimer(known + self.limit_ms)
            self.job.update((start, False))
            self.handle.registerTimer(start + self.limit_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start, ended = self.job.get()
        if ended:
            self.job.clear()
        else:
            yield self._end(key, "timeout", start, start + self.limit_ms)

    def _end(self, key, outcome: str, start: int, end: int) -> Row:
        self.job.update((start, True))
        if self.remember_ms is not None:
            self.handle.registerTimer(end + self.remember_ms)
        return Row(job_id=key[0], outcome=outcome, started_ms=start, ended_ms=end)

    def close(self) -> None:
        pass


class Deadlines(StatefulProcessor):
    """The rules of ``Deadline`` for all jobs of a bucket together, with one state and one timer.

    A call for each job's state and timer takes longer than all else. Here the jobs of a bucket that run or are remembered
    are one stored table, which is brought up to date as a whole when rows come or the earliest of their times is over.
    """

    def __init__(self, limit_ms: int, remember_ms: int | None) -> None:
        self.limit_ms = limit_ms
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("jobs", BUCKET_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots = [r[["job_id", "first_ms", "done_ms"]] for r in rows]
        yield from self._update(slots, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._update([], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _update(self, slots: list[pd.DataFrame], watermark: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        state = self.bucket.get()
        known, due = (JOBS.empty_table(), None) if state is None else (pa.ipc.open_stream(state[0]).read_all(), state[1])
        # a row per job; times in milliseconds are exact as doubles
        jobs = pd.concat([known.to_pandas(), *slots]).reindex(
            columns=["job_id", "started", "ended", "first_ms", "done_ms"]).astype(
            {c: "float64" for c in ("started", "ended", "first_ms", "done_ms")}).groupby(
            "job_id", dropna=False, sort=False).min().reset_index()
        running = jobs["ended"].isna()
        start = jobs["started"].where(~running, np.fmin(jobs["started"], jobs["first_ms"]))
        finished = running & (jobs["done_ms"] <= start + self.limit_ms)
        overdue = running & ~finished & (start + self.limit_ms < watermark)
        end = jobs["ended"].mask(finished, jobs["done_ms"]).mask(overdue, start + self.limit_ms)
        if (finished | overdue).any():
            new = finished | overdue
            yield pd.DataFrame({
                "job_id": jobs["job_id"][new], "outcome": np.where(finished[new], "finished", "timeout"),
                "started_ms": start[new].astype("int64"), "ended_ms": end[new].astype("int64")})

        until = end + self.remember_ms if self.remember_ms is not None else end * np.nan
        kept = ~(until < watermark)
        times = until.where(end.notna(), start + self.limit_ms)[kept].dropna()
        next_due = int(times.min()) if len(times) else None
        if due != next_due:
            if due is not None and due != fired:
                self.handle.deleteTimer(due)
            if next_due is not None:
                self.handle.registerTimer(next_due)
        if not kept.any():
            self.bucket.clear()
            return
        left = pa.table([pa.array(jobs["job_id"][kept], pa.string(), from_pandas=True),
                         pa.array(start[kept].astype("int64"), pa.int64()),
                         pa.array(end[kept].astype("Int64"), pa.int64())], schema=JOBS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, JOBS) as writer:
            writer.write_table(left)
        self.bucket.update((sink.getvalue().to_pybytes(), next_due))

    def close(self) -> None:
        pass


def stream_lifecycle(
    stream: DataFrame, done: Column, watermark: str, max_hours: int = MAX_RUNTIME_HOURS,
    job: str = "job_id", ts: str = "ts", remember_hours: int | None = REMEMBER_HOURS,
    buckets: int | None = BUCKETS,
) -> DataFrame:
    """One row per job that ended: finished within the limit, or timed out.

    A job is forgotten ``remember_hours`` after its end; an event after that starts it anew and gives
    a second outcome. None remembers all jobs, in a state that grows with their number.

    Events are first summed up per job and minute, before the shuffle, so that the state
    of a very busy job is updated once per minute of event time rather than per event. Jobs share states,
    ``buckets`` of them; with None each has its own, which suits few jobs that run for long.
    """
    at = F.unix_millis(ts)
    slots = (
        stream.withWatermark(ts, watermark)
        .groupBy(F.col(job).cast("string").alias("job_id"), F.window(ts, SLOT).alias("slot"))
        .agg(F.min(at).alias("first_ms"), F.min(F.when(done, at)).alias("done_ms"))
        .select("job_id", F.window_time("slot").alias("at"), "first_ms", "done_ms")
    )
    times = (max_hours * HOUR_MS, None if remember_hours is None else remember_hours * HOUR_MS)
    kind = {"outputStructType": OUTPUT, "outputMode": "append", "timeMode": "eventtime"}
    if buckets is None:
        ended = slots.groupBy("job_id").transformWithState(statefulProcessor=Deadline(*times), **kind)
    else:
        ended = slots.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets))).groupBy(
            "bucket").transformWithStateInPandas(statefulProcessor=Deadlines(*times), **kind)
    return ended.select("job_id", "outcome", F.timestamp_millis("started_ms").alias("started"),
                        F.timestamp_millis("ended_ms").alias("ended"))
