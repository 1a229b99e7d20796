"""A table of merged runs: few files, nothing lost or counted twice when a step fails; ties and nulls."""

from __future__ import annotations

import os
import random

import pytest

from tidemill.operators import catalog, jobs, manifest
from tidemill.sources import shared_files
from tidemill.streaming.upsert import FANOUT, KEPT_VERSIONS, ChangeTable

CHANGE = "id bigint, status string, seq bigint"


def some_changes(batches, seed=1):
    rng = random.Random(seed)
    return [[(rng.choice([None, *range(12)]), rng.choice("abc"), rng.choice([None, *range(40)]))
             for _ in range(rng.randint(1, 6))] for _ in range(batches)]


def newest(batches):
    best = {}
    for id_, status, seq in (c for b in batches for c in b):
        key = (seq is not None, -1 if seq is None else seq, status)
        if id_ not in best or key > best[id_][0]:
            best[id_] = (key, (id_, status, seq))
    return sorted((r for _, r in best.values()), key=repr)


def rows_of(table):
    return sorted(map(tuple, table.read(catalog.StructType.fromDDL(CHANGE)).collect()), key=repr)


def test_many_batches_leave_few_files(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "id", "seq")
    assert rows_of(table) == []
    batches = some_changes(22)
    for number, changes in enumerate(batches):
        table.add(spark.createDataFrame(changes, CHANGE).coalesce(1), "s", number)
        levels = [level for _, level in table.manifest().runs]
        assert all(levels.count(x) < FANOUT for x in levels)
    assert len(table.manifest().runs) <= (FANOUT - 1) * 3 and rows_of(table) == newest(batches)
    assert len(os.listdir(tmp_path / "t/manifest")) <= 2 * KEPT_VERSIONS  # with their checksum files
    assert len(os.listdir(tmp_path / "t/runs")) <= (FANOUT - 1) * 3 + FANOUT * KEPT_VERSIONS
    for number in (21, 0):  # run again
        table.add(spark.createDataFrame([(1, "z", 99)], CHANGE), "s", number)
    assert rows_of(table) == newest(batches)
    table.add(spark.createDataFrame([(1, "z", 99)], CHANGE), "another stream", 0)
    assert (1, "z", 99) in rows_of(table)


@pytest.mark.parametrize("failing", [1, 4, 5, 6])
def test_a_failure_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch, failing):
    table = ChangeTable(spark, str(tmp_path / "t"), "id", "seq")
    batches = some_changes(6, seed=failing)
    swap, calls = ChangeTable.swap, []

    def fails_once(self, now):
        calls.append(now)
        if len(calls) == failing:
            raise RuntimeError("lost")
        swap(self, now)

    monkeypatch.setattr(ChangeTable, "swap", fails_once)
    for number, changes in enumerate(batches):
        df = spark.createDataFrame(changes, CHANGE).coalesce(1)
        before, merging = rows_of(table), table.manifest().last_batch.get("s", -1)
        try:
            table.add(df, "s", number)
        except RuntimeError:
            now = rows_of(table)
            assert now == before or now == newest(batches[:number + 1])  # the batch's swap, or a merge's
            assert merging == number - 1
            table.add(df, "s", number)
        assert rows_of(table) == newest(batches[:number + 1])
    named = {name for v in table.versions() for name, _ in table.manifest(v).runs}
    assert set(os.listdir(tmp_path / "t/runs")) == named  # nothing is left of what failed


def test_manifests_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    shared_files.create_text(spark, path, "é1")
    with pytest.raises(FileExistsError):
        shared_files.create_text(spark, path, "2")
    assert shared_files.read_text(spark, path) == "é1" and shared_files.names(spark, str(tmp_path / "m")) == ["1.json"]
    assert shared_files.names(spark, str(tmp_path / "none")) == []


def both_orders(spark, rows, schema, run):
    """The result must not depend on the order of the input rows."""
    results = []
    for r in (rows, rows[::-1]):
        for parts in (1, 3):
            results.append(sorted(map(str, run(spark.createDataFrame(r, schema).repartition(parts)).collect())))
            results.append(sorted(map(str, run(spark.createDataFrame(r, schema).coalesce(1)).collect())))
    assert all(r == results[0] for r in results)
    return results[0]


def test_ties_do_not_depend_on_arrival(spark):
    rows = [(1, "b", 5), (1, "a", 5), (None, "x", None), (None, "y", None), (2, None, 1), (2, "c", 1), (2, "d", None)]
    assert both_orders(spark, rows, CHANGE, lambda d: catalog.latest(d, ["id"], "seq")) == sorted(
        map(str, spark.createDataFrame([(1, "b", 5), (None, "y", None), (2, "c", 1)], CHANGE).collect()))
    both_orders(spark, rows, CHANGE, lambda d: catalog.kv_latest(d, "id", "status", "seq"))
    both_orders(spark, rows, CHANGE, lambda d: manifest.merge_last_wins(d, "id", "status", "seq"))
    both_orders(spark, rows, CHANGE, lambda d: catalog.catalog_get(d, "id", 1, "seq"))
    maps = [(1, {"a": "1"}, 5), (1, {"b": "2"}, 5)]
    both_orders(spark, maps, "id bigint, m map<string,string>, seq bigint", lambda d: catalog.latest(d, ["id"], "seq"))
    updates = [("t", "running", 0.2, 3), ("t", "failed", 0.1, 3), ("t", "running", 0.9, 1)]
    got = both_orders(spark, updates, "tune_id string, status string, progress double, seq int", jobs.latest_status)
    assert "status='running', progress=0.2" in got[0]
    waiting = spark.createDataFrame([("j", "pending", None)], "job_id string, status string, error string")
    both_orders(spark, [("j", "e1", 1), ("j", "e2", 1)], "job_id string, error string, seq int",
                lambda d: jobs.fail_jobs(waiting, d))


def test_null_ids_and_times(spark):
    old = spark.createDataFrame([(None, "old", 1), (None, "older", 0), (3, "c", 1)], CHANGE)
    change = spark.createDataFrame([(None, "new", 0)], CHANGE)
    assert sorted(map(tuple, catalog.catalog_upsert(old, change, "id", "seq").collect()), key=repr) == [
        (3, "c", 1), (None, "new", 0)]
    assert catalog.insert_if_absent(old, change, "id").count() == 3
    assert catalog.insert_if_absent(old.where("id = 3"), change, "id").count() == 2
    reports = spark.createDataFrame([(3, "done", None)], CHANGE)
    assert list(map(tuple, catalog.status_sync(old.where("id = 3"), reports, "id", updated="seq").collect())) == [(3, "done", 1)]
