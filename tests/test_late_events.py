"""Counts and corrections add up to the batch result, whatever order the events come in."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemill.operators.events import tumbling_counts
from tidemill.session import settings
from tidemill.streaming import late, lifecycle, runs

EVENT = "event_id bigint, ts timestamp, event_type string"


def test_counts_and_corrections_of_shuffled_events(spark, tmp_path):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=rng.randint(0, 600), microseconds=i), rng.choice([None, "a", "b"]))
            for i in range(300)]
    rows += [(1000 + i, t0 + dt.timedelta(hours=3), "a") for i in range(100)]  # at the start of a window
    rng.shuffle(rows)
    folder = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(rows[part::4], EVENT).coalesce(1).write.mode("append").parquet(folder)
    stream = runs.event_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    with settings(spark, {**lifecycle.STATE_STORE, "spark.sql.shuffle.partitions": "2"}):
        runs.run_to_files(late.counts_and_corrections(stream, 3600, "1 hour"), out, str(tmp_path / "cp"))
    got = late.corrected(spark.read.parquet(out))
    closed = max(r[1] for r in rows) - dt.timedelta(hours=1)
    want = tumbling_counts(spark.createDataFrame(rows, EVENT), "1 hour").where(F.col("window_end") <= F.lit(closed))
    assert sorted(map(str, got.select("window_start", "event_type", "n").collect())) == sorted(
        map(str, want.select("window_start", "event_type", "n").collect()))
    assert got.agg(F.sum("n_late")).first()[0] > 50  # several batches, so many are late
