"""Streams over several micro-batches give what one batch gives, and a rerun adds nothing."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators.catalog import latest
from tidemill.session import settings, table
from tidemill.sources.logs import stream_log
from tidemill.streaming import lifecycle, runs, upsert, usage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sliced(spark, tmp_path_factory):
    """The events in four files, one per stretch of time."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = table(spark, SF, "events")
    for i in range(4):
        events.where(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(folder)
    return folder, events.schema


def source(spark, sliced, per_trigger=1):
    folder, schema = sliced
    return runs.event_stream(spark, folder, schema, files_per_trigger=per_trigger)


def collect(spark, df, path):
    return sorted(map(str, spark.read.schema(df.schema).parquet(path).collect()))


@pytest.mark.parametrize("build", [
    lambda s: usage.windowed_counts(s, "1 hour", "30 days"),
    lambda s: usage.dedup_stream(s, "event_id", "30 days").select("event_id", "user_id"),
], ids=["counts", "dedup"])
def test_batch_cuts_do_not_matter(spark, sliced, tmp_path, build):
    outs = []
    for label, per_trigger in (("one", 1), ("all", 1000)):
        df = build(source(spark, sliced, per_trigger))
        out = str(tmp_path / label)
        runs.run_to_files(df, out, str(tmp_path / f"{label}-cp"))
        outs.append(collect(spark, df, out))
    assert outs[0] == outs[1]


def test_rerun_adds_nothing(spark, sliced, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    df = usage.dedup_stream(source(spark, sliced), "event_id", "30 days").select("event_id")
    runs.run_to_files(df, out, checkpoint)
    first = collect(spark, df, out)
    again = usage.dedup_stream(source(spark, sliced), "event_id", "30 days").select("event_id")
    runs.run_to_files(again, out, checkpoint)
    assert len(first) == 1000 and collect(spark, df, out) == first


def test_upsert_over_batches(spark, sliced, tmp_path):
    changes = source(spark, sliced).select("user_id", "event_type", "event_id")
    target = str(tmp_path / "t")
    upsert.stream_upsert(changes, target, str(tmp_path / "cp"), "user_id", "event_id")
    got = upsert.current(spark, target, changes.schema, "user_id", "event_id")
    want = latest(table(spark, SF, "events").select("user_id", "event_type", "event_id"),
                  ["user_id"], "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 1


def test_job_deadlines_over_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def at(hours):
        return t0 + dt.timedelta(hours=hours)

    files = [
        [("fast", at(0), "start"), ("slow", at(0), "start"), ("edge", at(0), "start")],
        [("fast", at(1), "done"), ("edge", at(3), "done"), ("late", at(2), "start")],
        [("slow", at(4), "done"), ("clock", at(9), "start")],
        [("clock", at(20), "tick")],
    ]
    folder = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, "job_id string, ts timestamp, kind string").coalesce(1).write.mode(
            "append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    results = []
    for label, per_trigger in (("one", 1), ("all", 100)):
        stream = runs.event_stream(spark, folder, schema, files_per_trigger=per_trigger)
        out = str(tmp_path / label)
        with settings(spark, lifecycle.STATE_STORE):
            ended = lifecycle.stream_lifecycle(stream, F.col("kind") == "done", "1 hour")
            runs.run_to_files(ended, out, str(tmp_path / f"{label}-cp"))
        results.append({(r["job_id"], r["outcome"], r["ended"]) for r in spark.read.parquet(out).collect()})
    assert results[0] == results[1] == {
        ("fast", "finished", at(1)), ("edge", "finished", at(3)), ("slow", "timeout", at(3)),
        ("late", "timeout", at(5)), ("clock", "timeout", at(12))}


def test_jobs_of_a_bucket_are_as_jobs_of_their_own(spark, tmp_path):
    """Few calls for many jobs: a shared state gives the outcomes of a state per job, over several batches."""
    t0, folder = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(
            [(None if n == 7 else f"j{n}", t0 + dt.timedelta(hours=3 * part, minutes=n * 7 % 200 + k), kind)
             for n in range(part * 20, part * 20 + 50) for k, kind in ((0, "start"), (n % 5 * 50, "done" if n % 3 else "tick"))],
            "job_id string, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    outs = []
    for buckets in (None, 3):
        out = str(tmp_path / f"out-{buckets}")
        with settings(spark, lifecycle.STATE_STORE):
            ended = lifecycle.stream_lifecycle(runs.event_stream(spark, folder, schema, files_per_trigger=1),
                                               F.col("kind") == "done", "1 hour", remember_hours=24, buckets=buckets)
            runs.run_to_files(ended, out, str(tmp_path / f"cp-{buckets}"))
        outs.append(sorted(map(str, spark.read.parquet(out).collect())))
    assert outs[0] == outs[1] and {"finished", "timeout"} == {w for r in outs[0] for w in ("finished", "timeout") if w in r}


def test_a_bucket_takes_few_calls():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.calls.append(at)

        def deleteTimer(self, at):
            self.calls.append(-at)

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    handle, jobs = Handle(), lifecycle.Deadlines(100, 1000)
    jobs.init(handle)
    rows = pd.DataFrame({"job_id": [f"j{i}" for i in range(999)] + [None], "at": 0, "first_ms": range(1000),
                         "done_ms": [i + 5.0 if i % 2 else None for i in range(1000)]})
    out = pd.concat(jobs.handleInputRows((0,), iter([rows[:400], rows[400:]]), Times(0)))
    assert set(out["outcome"]) == {"finished"} and len(out) == 500
    assert handle.calls == ["get", 100, "update"]
    out = pd.concat(jobs.handleExpiredTimer((0,), Times(300), Times(100)))
    assert out["job_id"].tolist() == [f"j{i}" for i in range(0, 200, 2)] and set(out["outcome"]) == {"timeout"}
    assert not list(jobs.handleInputRows((0,), iter([rows[:1]]), Times(300)))  # it has ended
    assert len(pd.concat(jobs.handleExpiredTimer((0,), Times(5000), Times(300)))) == 400 and handle.value is None


def test_log_segments(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "0.log").write_text("a\nb\n")
    df = stream_log(spark, str(folder))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    runs.run_to_files(df, out, checkpoint)
    (folder / "1.log").write_text("c\n")
    runs.run_to_files(stream_log(spark, str(folder)), out, checkpoint)
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_jobs_are_forgotten_only_if_asked():
    from tidemill.streaming.lifecycle import Deadline

    class Handle:
        def __init__(self):
            self.timers, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.append(at)

    for remember, timers in ((50, [57]), (None, [])):
        job, handle = Deadline(100, remember), Handle()
        job.init(handle)
        rows = [{"first_ms": 3, "done_ms": 7}]
        assert [r["outcome"] for r in job.handleInputRows(("j",), iter(rows), None)] == ["finished"]
        assert handle.timers == timers and not list(job.handleInputRows(("j",), iter(rows), None))
