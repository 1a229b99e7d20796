"""Alerts of a stream are those of the whole table, whatever the batches and the order within the delay."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.operators.billing import cost_alerts
from tidemill.streaming import alerts, runs

ROW = "event_id bigint, user_id string, ts timestamp, cost decimal(18,6)"
T0 = dt.datetime(2024, 1, 25)
MARKS, LIMIT = [1.0, 20.0, 60.0], 40.0


def usage(n, seed):
    """Two months, half of the rows by one user, ties in time, rows without user, time or cost."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.5 else rng.choice([None, "a", "b"])
        ts = None if i % 50 == 49 else T0 + dt.timedelta(minutes=10 * rng.randrange(0, 14 * 144))
        rows.append((i, user, ts, None if i % 41 == 40 else Decimal(rng.randrange(0, 300)) / 100))
    return rows


def feed(spark, tmp_path, parts, delay):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in parts:
        spark.createDataFrame(part, ROW).write.mode("append").parquet(folder)
        stream = runs.event_stream(spark, folder, spark.createDataFrame([], ROW).schema)
        alerts.stream_cost_alerts(stream, out, checkpoint, MARKS, LIMIT, delay_seconds=delay)
    return alerts.alerts(spark, out)


def same(got, want):
    names = ["user_id", "month", "threshold", "ts", "event_id", "running_cost", "stop"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))


@pytest.mark.parametrize("cuts", [1, 3, 6])
def test_same_alerts_for_any_cuts(spark, tmp_path, cuts):
    rows = usage(400, 5)
    rng = random.Random(cuts)
    came = {r[0]: (r[2] or T0) + dt.timedelta(seconds=rng.randrange(0, 86400)) for r in rows}
    order = sorted(rows, key=lambda r: came[r[0]])
    size = -(-len(order) // cuts)
    got = feed(spark, tmp_path, [order[i:i + size] for i in range(0, len(order), size)], 86400)
    over = max(r[2] for r in rows if r[2]) - dt.timedelta(days=1)
    whole = cost_alerts(spark.createDataFrame(rows, ROW), MARKS, LIMIT)
    same(got, whole.where(F.col("ts") <= F.lit(over)))
    assert got.where("late").isEmpty() and got.count() > 8


def test_late_rows_are_added_and_marked(spark, tmp_path):
    def at(hours, i, cost, user="a"):
        return (i, user, T0 + dt.timedelta(hours=hours), Decimal(cost))

    got = feed(spark, tmp_path, [[at(0, 1, "0.6"), at(5, 2, "0.1")], [at(1, 3, "0.5"), at(6, 4, "0.1")],
                                 [at(2, 5, "50"), at(9, 6, "0.1")]], 3600)
    seen = {(float(r["threshold"]), r["event_id"], float(r["running_cost"]), r["late"], r["batch"]) for r in got.collect()}
    # event 5 is not added to what was there at its own time but to all that was closed
    assert seen == {(1.0, 3, 1.1, True, 1), (20.0, 5, 51.2, True, 2), (40.0, 5, 51.2, True, 2)}


def test_batch_that_runs_again(spark, tmp_path, monkeypatch):
    rows = usage(200, 9)
    folder = str(tmp_path / "state")
    def state():
        return alerts.AlertState(spark, folder, "stream", MARKS, LIMIT, 0, "user_id", "ts", "event_id")

    parts = [spark.createDataFrame(p, ROW) for p in (rows[:100], rows[100:])]
    state().add(parts[0], 0)
    with monkeypatch.context() as patch:
        def lost(*_):
            raise OSError("lost before the manifest")
        patch.setattr(alerts.ChangeTable, "swap", lost)
        with pytest.raises(OSError):
            state().add(parts[1], 1)
    state().add(parts[1], 1)
    first = sorted(map(str, alerts.alerts(spark, folder).collect()))
    state().add(parts[1], 1)
    assert sorted(map(str, alerts.alerts(spark, folder).collect())) == first
    assert len({(r["user_id"], r["month"], r["threshold"]) for r in alerts.alerts(spark, folder).collect()}) == len(first)


def test_no_times_and_no_rows(spark, tmp_path):
    got = feed(spark, tmp_path, [[(1, "a", None, Decimal(5))], [(2, "a", T0, None)]], 0)
    assert got.isEmpty()
