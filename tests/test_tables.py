"""Batches, catalogs, jobs, manifests, billing, sessions, files: edges and brute force."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.operators import batching, billing, catalog, events, jobs, manifest, metrics, telemetry, vocab
from tidemill.operators import chat as chat_module
from tidemill.operators.chat import chat_blocks, chat_context, turn_pairs
from tidemill.operators.select import expand_epochs, validate_accelerator, validate_requests
from tidemill.plans.order import by_id, dense_rank
from tidemill.session import settings_table
from tidemill.sources import catalog_json, examples, files, logs


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect())


# --- batches -----------------------------------------------------------------------------

def test_batches_are_full_but_the_last(spark):
    ranked = dense_rank(spark.range(23), by_id("id"), total="total")
    sizes = dict(rows(batching.assign_batches(ranked, 5).groupBy("batch_id").count()))
    assert sizes == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}
    dropped = batching.assign_batches(ranked, 5, drop_last=True)
    assert dropped.count() == 20


def test_batch_larger_than_the_data(spark):
    ranked = dense_rank(spark.range(3), by_id("id"), total="total")
    assert batching.assign_batches(ranked, 10).select("batch_id").distinct().count() == 1
    assert batching.assign_batches(ranked, 10, drop_last=True).count() == 0


def test_drop_last_per_split(spark):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("test"))
    ranked = dense_rank(df, by_id("id"), keys=["split"], total="total")
    kept = batching.assign_batches(ranked, 3, drop_last=True)
    assert dict(rows(kept.groupBy("split").count())) == {"train": 6, "test": 3}


def test_collate_keeps_order(spark):
    ranked = dense_rank(spark.range(5), by_id("id")).withColumn("ids", F.array("id"))
    got = batching.collate(batching.assign_batches(ranked, 2), ["ids"])
    assert rows(got) == [(0, 2, [[0], [1]]), (1, 2, [[2], [3]]), (2, 1, [[4]])]


def test_uneven_shards_are_refused(spark):
    with pytest.raises(ValueError):
        batching.assign_dp_shards(spark.range(1), 10, 3)


def test_epochs_restart_the_step_limit(spark):
    batches = spark.range(4).withColumnRenamed("id", "batch_id")
    got = rows(expand_epochs(batches, 2, 3), "epoch", "batch_id")
    assert got == [(e, b) for e in range(2) for b in range(3)]
    assert expand_epochs(batches, 0).count() == 0


def test_shape_check_reports_bad_batches(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [1]), (1, [1, 2])], "batch_id bigint, ids array<int>")
    assert rows(batching.batch_shape_check(df, ["ids"], 2), "batch_id", "ok") == [(0, False), (1, True)]


# --- chat --------------------------------------------------------------------------------

def chat(spark, turns):
    return spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")


def test_pairs_skip_open_turns_and_find_the_system_text(spark):
    df = chat(spark, [
        (1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
        (2, 0, "user", "x"), (2, 5, "assistant", "y"), (2, 6, "assistant", "z")])
    assert rows(turn_pairs(df), "example_id", "instruction", "input", "output") == [
        ("1:1", "u1", "S", "a1"), ("2:0", "x", "", "y")]


def test_pairs_across_segments(spark, monkeypatch):
    monkeypatch.setattr(chat_module, "TURN_SHIFT", 6)
    turns = [(1, 0, "system", "S")] + [
        (1, t, "user" if t % 2 else "assistant", str(t)) for t in range(1, 2001)]
    got = turn_pairs(chat(spark, turns))
    assert got.count() == 1000
    assert got.where("output <> cast(instruction + 1 as string) or input <> 'S'").count() == 0


def test_blocks_and_tail_are_the_whole_history(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", str(t)) for t in range(200)]
    df = chat(spark, turns)
    blocks = {r["block_no"]: [m["content"] for m in r["messages"]] for r in chat_blocks(df).collect()}
    for r in chat_context(df).collect():
        before = [c for b in sorted(blocks) if b < r["block_no"] for c in blocks[b]]
        history = before + [m["content"] for m in r["tail"]]
        assert history == [str(t) for t in range(r["turn"])]
        assert r["n_earlier"] == len(before)


# --- metrics -----------------------------------------------------------------------------

def test_loss_is_stable_for_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([-1000.0, 1000.0], 0)], "v array<float>, label int")
    got = [r["n"] for r in df.select(metrics.token_nll(F.col("v"), F.col("label")).alias("n")).collect()]
    assert got == [0.0, 2000.0]


def test_first_maximum_wins(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1.0, 3.0, 3.0], 2)], "v array<float>, label int")
    assert rows(df.select("label", metrics.is_correct(F.col("v"), F.col("label")).alias("c"))) == [
        (1, 1), (2, 0)]


def test_empty_masks_count_as_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, 9.0, 0), (2, 5.0, 0)], "s int, nll double, mask int")
    assert metrics.loss_seq_mean(df, "s", "nll", "mask").first()["loss"] == 1.0
    assert metrics.loss_token_mean(df, "nll", "mask").first()["loss"] == pytest.approx(2.0)


def test_eval_mean_overweights_a_short_batch(spark):
    df = spark.createDataFrame(
        [(0, 1, 1.0, 1, 1), (0, 2, 3.0, 0, 1), (1, 3, 8.0, 1, 1)],
        "batch int, s int, nll double, correct int, mask int")
    all_of_it = metrics.eval_mean(df, "batch", "s", "nll", "correct", "mask").first()
    assert (all_of_it["n_batches"], all_of_it["loss"], all_of_it["accuracy"]) == (2, 5.0, 0.75)
    for unlimited in (0, None):
        assert metrics.eval_mean(df, "batch", "s", "nll", "correct", "mask", unlimited).first()["loss"] == 5.0
    assert metrics.eval_mean(df, "batch", "s", "nll", "correct", "mask", 1).first()["loss"] == 2.0


# --- telemetry ---------------------------------------------------------------------------

def test_log_lines(spark):
    df = spark.createDataFrame([
        ("Step 3 | Train Loss: 1.5000 | Val Loss: 0.0000 | ",), ("Step x",),
        ("Step 4 | Train Loss: nan | Val Loss: 2.0 |",)], "value string")
    got = telemetry.parse_step_log(df).collect()
    assert [r["matched"] for r in got] == [True, False, True]
    assert (got[0]["step"], got[0]["train_loss"], got[1]["step"], got[2]["val_loss"]) == (3, 1.5, None, 2.0)
    assert got[2]["train_loss"] != got[2]["train_loss"]


def test_schedule(spark):
    plan = telemetry.step_schedule(spark.range(7).withColumnRenamed("id", "step"), 3, 0, 5)
    assert rows(plan) == [
        (0, False, False, False), (1, True, False, False), (2, True, False, False),
        (3, False, False, False), (4, False, False, True), (5, True, False, False),
        (6, False, False, True)]


def test_throughput_without_time(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("b", 2.0)], "run string, s double")
    assert {r["run"]: r["steps_per_sec"] for r in telemetry.throughput(df, "run", "s").collect()} == {
        "a": None, "b": 0.5}


# --- catalog -----------------------------------------------------------------------------

def test_get_takes_the_earliest_duplicate(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 0)], "id string, seq int")
    assert rows(catalog.catalog_get(df, "id", "a", "seq")) == [("a", 1)]
    assert rows(catalog.catalog_get(df, "id", "zz", "seq")) == []


def test_upsert_is_idempotent_and_replaces_duplicates(spark):
    base = spark.createDataFrame([("a", "old", 1), ("a", "older", 0), ("b", "keep", 2)],
                                 "id string, v string, seq int")
    changes = spark.createDataFrame([("a", "x", 5), ("a", "new", 6), ("c", None, 7)],
                                    "id string, v string, seq int")
    once = catalog.catalog_upsert(base, changes, "id", "seq")
    twice = catalog.catalog_upsert(once, changes, "id", "seq")
    expected = {("a", "new", 6), ("b", "keep", 2), ("c", None, 7)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == expected


def test_tombstones(spark):
    log = spark.createDataFrame([("k", "v", 1), ("k", None, 2), ("m", None, 1), ("m", "w", 2)],
                                "key string, value string, seq int")
    assert rows(catalog.kv_latest(log)) == [("m", "w")]


def test_map_status_of_null(spark):
    df = spark.createDataFrame([("READY",), ("??",), (None,)], "s string")
    got = [r["status"] for r in catalog.map_status(df, "s", jobs.ACCELERATOR_STATES).collect()]
    assert got == ["ready", "unknown", "unknown"]


def test_prefix_delete_spares_longer_names(spark):
    df = spark.createDataFrame([("x/a",), ("x2/a",), ("x",)], "name string")
    assert rows(files.prefix_delete(df, "x")) == [("x2/a",)]
    assert rows(files.prefix_delete(df, "x/")) == [("x2/a",)]


def test_validation_reasons(spark):
    df = spark.createDataFrame(
        [("llama3_1-8b", "d", None), ("x", None, "hub/d"), (None, None, None)],
        "model string, dataset_id string, dataset_path string")
    assert [r["reasons"] for r in validate_requests(df).collect()] == [
        [], ["unsupported_model"], ["unsupported_model", "missing_dataset"]]
    machines = spark.createDataFrame([("v3", 8), ("v3", 12), ("v4", 1032), ("v5p", 1024)],
                                     "accelerator_type string, cores int")
    assert [r["valid"] for r in validate_accelerator(machines).collect()] == [True, False, False, True]


# --- jobs --------------------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)


def test_due_exactly_at_the_deadline(spark):
    hour = dt.timedelta(hours=1)
    df = spark.createDataFrame([
        ("a", "cleanup", T0 + hour, T0), ("b", "cleanup", T0, T0 + hour), ("c", "running", None, T0),
        ("d", "running", T0, T0)], "id string, status string, next_update_at timestamp, cleanup_at timestamp")
    got = jobs.due_jobs(df, F.lit(T0))
    assert rows(got, "id", "action") == [("a", "cleanup"), ("b", "update"), ("d", "update")]


def test_runtime_limit_is_exclusive(spark):
    limit = dt.timedelta(hours=3)
    df = spark.createDataFrame([
        ("at", "running", T0 - limit), ("over", "running", T0 - limit - dt.timedelta(seconds=1)),
        ("done", "stopped", T0), ("bad", "error", T0), ("wait", "pending", T0 - 2 * limit)],
        "id string, tune_status string, created_at timestamp").withColumns({
            "status": F.lit("running"), "error": F.lit(None).cast("string")})
    got = jobs.finetune_transition(df, F.lit(T0))
    assert dict(rows(got, "id", "next_status")) == {
        "at": "running", "over": "cleanup", "done": "cleanup", "bad": "failed", "wait": "running"}


# --- manifest ----------------------------------------------------------------------------

def test_shared_and_unowned_shards(spark):
    shards = spark.createDataFrame([(s,) for s in (4, 15, 16, 31)], "shard int")
    got = rows(manifest.assign_shards(shards, manifest.range_table(spark)), "shard", "worker")
    assert got == [(4, 0), (4, 1), (15, 3), (16, 4)]


@pytest.mark.parametrize("spread", [1, 5])
def test_range_join_equals_brute_force(spark, spread):
    rng = random.Random(5)
    ranges = [(i, lo, lo + rng.randrange(40)) for i, lo in enumerate(rng.sample(range(-50, 200), 25))]
    ranges += [(90, -2**31, 2**31 - 1), (91, 9, 8), (92, None, 5), (93, 0, 0)]
    points = [rng.randrange(-60, 260) for _ in range(100)] + [7] * 50
    table = settings_table(spark, ranges, {"worker": pa.int32(), "lo": pa.int32(), "hi": pa.int32()})
    got = manifest.range_join(
        spark.createDataFrame([(p,) for p in [*points, None]], "p int"), table, "p", spread)
    ranges = [r for r in ranges if r[1] is not None]
    assert rows(got, "p", "worker") == sorted(
        (p, w) for p in points for w, lo, hi in ranges if lo <= p <= hi)


def test_wide_ranges_have_few_cells(spark):
    rng = random.Random(6)
    ends = [(0, 50_000_000), (1, 50_000_000), (-7, 2**61), (5, 5), (3, 2), (-2**40, -1)]
    ends += [tuple(sorted((rng.randrange(-300, 300), rng.randrange(-300, 300)))) for _ in range(100)]
    df = spark.createDataFrame(ends, "lo bigint, hi bigint").select(
        "lo", "hi", manifest.dyadic_cells(F.col("lo"), F.col("hi")).alias("cells"))
    for r in df.collect():
        spans = sorted((c["cell"] << c["level"], ((c["cell"] + 1) << c["level"]) - 1) for c in r["cells"])
        assert len(spans) <= 2 * max(1, (r["hi"] - r["lo"] + 1).bit_length()) and len(spans) < 130
        at = r["lo"]
        for low, high in spans:
            assert low == at
            at = high + 1
        assert at == max(r["lo"], r["hi"] + 1)
        assert len(spans) < 60 or r["hi"] > 2**50


def test_file_without_a_number(spark):
    df = spark.createDataFrame([("model-00004-of-00030.safetensors",), ("config.json",)], "f string")
    assert [r["n"] for r in df.select(manifest.shard_number(F.col("f")).alias("n")).collect()] == [4, None]


# --- billing and sessions ----------------------------------------------------------------

def usage_rows(n, seed):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}",
             T0 + dt.timedelta(seconds=rng.randrange(0, 50 * 86400)), Decimal(rng.randrange(1, 500)) / 100)
            for i in range(n)]


def test_alerts_equal_brute_force(spark):
    data = usage_rows(600, 3)
    df = spark.createDataFrame(data, "event_id bigint, user_id string, ts timestamp, cost decimal(18,6)")
    marks = [1.0, 50.0, 200.0, 100000.0]
    got = {(r["user_id"], r["month"], float(r["threshold"])): (r["event_id"], r["running_cost"], r["stop"])
           for r in billing.cost_alerts(df, marks, limit=50.0).collect()}
    want = {}
    totals: dict = {}
    for i, user, ts, cost in sorted(data, key=lambda r: (r[2], r[0])):
        key = (user, ts.strftime("%Y-%m"))
        before = totals.get(key, Decimal(0))
        totals[key] = before + cost
        for m in marks:
            if before < Decimal(str(m)) <= totals[key]:
                want[(*key, m)] = (i, totals[key], m >= 50.0)
    assert got == want


def test_minimum_seconds(spark):
    prices = billing.pricing_table(spark, [("A100", 36.0, 60)])
    df = spark.createDataFrame([("A100", 10), ("A100", 100), ("??", 5)], "gpu_type string, duration_seconds int")
    plain = billing.job_cost(df, prices).collect()
    least = billing.job_cost(df, prices, minimum=True).collect()
    assert [r["cost"] for r in plain] == [Decimal("0.1"), Decimal("1"), None]
    assert [r["billed_seconds"] for r in least][:2] == [60, 100]


def test_sessions_equal_brute_force(spark):
    data = [(i, u, t, float(c)) for i, u, t, c in usage_rows(400, 9)]
    gap = 6 * 3600
    df = spark.createDataFrame(data, "event_id bigint, user_id string, ts timestamp, value double")
    got = rows(events.session_events(df, gap), "user_id", "session_start", "last_event", "n_events")
    want, by_user = [], {}
    for _, user, ts, _ in sorted(data, key=lambda r: r[2]):
        current = by_user.setdefault(user, [])
        if current and (ts - current[-1][1]).total_seconds() < gap:
            current[-1] = (current[-1][0], ts, current[-1][2] + 1)
        else:
            current.append((ts, ts, 1))
    for user, found in by_user.items():
        want += [(user, *s) for s in found]
    assert got == sorted(want)


def test_a_gap_of_exactly_the_limit_splits(spark):
    df = spark.createDataFrame(
        [("u", T0, 1.0), ("u", T0 + dt.timedelta(seconds=59), 1.0), ("u", T0 + dt.timedelta(seconds=119), 1.0)],
        "user_id string, ts timestamp, value double")
    assert [r[0] for r in rows(events.session_events(df, 60), "n_events")] == [1, 2]


# --- files, logs, vocabulary -------------------------------------------------------------

def test_chunks_out_of_order_missing_and_repeated(spark):
    df = spark.createDataFrame([
        ("a", 2, 3, "c"), ("a", 0, 3, "a"), ("a", 1, 3, "b"), ("a", 1, 3, "b"),
        ("b", 2, 3, "z"), ("b", 0, 3, "x"), ("c", 0, 1, "")],
        "upload_id string, chunk_number int, total_chunks int, content string")
    assert rows(files.reassemble_chunks(df)) == [("a", 0, 0, 3, "abc"), ("c", 0, 0, 0, "")]
    assert rows(files.reassemble_chunks(df, chunks_per_part=2)) == [
        ("a", 0, 0, 3, "ab"), ("a", 1, 2, 3, "c"), ("c", 0, 0, 0, "")]


def test_log_offset_inside_a_line(spark):
    df = spark.createDataFrame([("f", 1, "héllo"), ("f", 2, "x"), ("g", 1, "")],
                               "file string, line_no bigint, value string")
    assert rows(logs.log_from_offset(df, 3), "file", "value") == [("f", "llo"), ("f", "x")]
    assert rows(logs.out_of_range(df, 1)) == [("g", 1)]


def test_hardware_lines(spark, tmp_path):
    path = tmp_path / "hw.csv"
    path.write_text("timestamp,step,gpu_utilization,memory_used,memory_total\n"
                    "1.5,2,90,10.5,64\n1.5,2,GPU[0], 34C\n1.5,2,1,2\noops\n1.5,x,1,2,3\n")
    parsed, rejected = logs.read_hw_metrics(spark, str(path))
    assert sorted((r["status"], r["step"], r["gpu_utilization"], r["raw_line"]) for r in parsed.collect()) == [
        ("metrics", 2, 90.0, None), ("raw", 2, None, "1,2"), ("raw", 2, None, "GPU[0], 34C")]
    assert rows(rejected) == [("1.5,x,1,2,3",), ("oops",)]


def test_json_sources_and_dispatch(spark, tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text('{"input": "a", "response": ""}\n{"input": "b", "response": "c"}\n')
    assert rows(examples.load_source(spark, str(path), examples.REPLY)) == [("a", ""), ("b", "c")]
    examples.write_prepared(spark.createDataFrame(
        [("1", [1], [1], 1, 0, "train"), ("2", [2], [2], 1, 0, "test")], examples.PREPARED), str(tmp_path / "p"))
    kept = examples.read_prepared(spark, str(tmp_path / "p"), "train")
    assert rows(kept, "example_id") == [("1",)]
    assert "PartitionFilters: [isnotnull(split" in kept._jdf.queryExecution().executedPlan().toString()


def test_catalog_json_keeps_nulls_and_times(spark, tmp_path):
    df = spark.createDataFrame([("a", T0, ["x"], None)], "id string, at timestamp, tags array<string>, n int")
    catalog_json.write_catalog(df, str(tmp_path / "c"))
    assert catalog_json.read_catalog(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("12345")
    got = files.file_manifest(spark, str(tmp_path)).select(files.base_name(F.col("name")).alias("n"), "size_bytes")
    assert rows(got) == [("a.txt", 5)]


def test_vocab_plans_agree_on_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c a"), (1, "c a"), (2, None), (2, "b zz a")], "doc_id long, text string")
    known = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "word string, token_id int")
    for bound in (500, 1):
        got = vocab.encode_vocab(df, "doc_id", "text", known, max_broadcast=bound).collect()
        assert sorted(((r["doc_id"], r["text"] or "", r["ids"]) for r in got)) == [
            (1, "a b", [4, 5]), (1, "c a", [6, 4]), (1, "c a", [6, 4]), (2, "", []), (2, "b zz a", [5, 3, 4])]


def test_vocabulary_paths_agree(spark):
    texts = [(1, "b a  a\n"), (2, ""), (3, "a zz c b a")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    known = vocab.build_vocab(df, "text", 3)
    assert rows(known, "token_id", "word", "n") == [(4, "a", 4), (5, "b", 2), (6, "c", 1)]
    direct = rows(vocab.encode_vocab(df, "doc_id", "text", known), "doc_id", "ids")
    joined = rows(vocab.encode_vocab(df, "doc_id", "text", known, max_broadcast=1), "doc_id", "ids")
    assert direct == joined == [(1, [5, 4, 4]), (2, []), (3, [4, 3, 6, 5, 4])]


def test_flatten_keeps_whole_paths(spark):
    df = spark.sql("select 1 a, named_struct('b', 2, 'c', named_struct('b', 3)) s")
    assert catalog.flatten_struct(df).columns == ["a", "s.b", "s.c.b"]


def test_insert_if_absent_inserts_a_new_key_once(spark):
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "c"), (2, "b"), (3, None)], "k int, v string")
    got = catalog.insert_if_absent(have, new, "k").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a"), (2, "b"), (3, None)]


def test_latest_keeps_rows_without_sequence_numbers(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 5, "c"), (2, 4, "d")], "k int, seq int, v string")
    assert sorted(map(tuple, catalog.latest(rows, ["k"], "seq").collect())) == [(1, None, "a"), (2, 5, "c")]


@pytest.mark.parametrize("start, expected", [(1, "é日x"), (2, "日x"), (3, "日x"), (4, "x"), (5, "x"), (6, "x")])
def test_a_position_within_a_character(spark, start, expected):
    df = spark.createDataFrame([("f", 0, "aé日x")], "file string, line_no int, value string")
    assert rows(logs.log_from_offset(df, start), "value") == [(expected,)]


def test_binary_chunks_stay_binary(spark):
    df = spark.createDataFrame(
        [("a", 2, 1, b"\xff\x00"), ("a", 2, 0, b"\x80a")],
        "upload_id string, total_chunks int, chunk_number int, content binary")
    got = files.reassemble_chunks(df).first()
    assert (bytes(got["content"]), got["file_bytes"]) == (b"\x80a\xff\x00", 4)


def test_values_below_a_cent_count(spark):
    df = spark.sql("SELECT 'a' AS user_id, 'e' AS event_type, timestamp'2024-01-01' AS ts, 0.004D AS value"
                   " FROM range(2)")
    assert events.sliding_avg(df, 1, 60).first()["avg_value"] == 0.004
    assert events.session_events(df, 60).first()["total_value"] == 0.008


def test_sharded_loss_is_stable(spark):
    from tidemill.operators import metrics
    rows = [(0, 0, [1000.0, -1000.0]), (0, 2, [999.0, 1000.0]), (1, 0, [float("-inf")] * 2), (1, 2, [-1e6]),
            (2, 0, [0.0]), (2, 1, []), (3, 0, [5.0, 5.0])]
    labels = {0: 3, 1: 2, 2: 0, 3: 7}
    df = spark.createDataFrame([(t, f, x, labels[t]) for t, f, x in rows],
                               "token bigint, first int, logits array<double>, label int")
    got = {r["token"]: (r["nll"], r["correct"]) for r in metrics.token_nll_sharded(df, ["token"]).collect()}
    assert got[0][0] == pytest.approx(math.log(2 + math.exp(-1))) and got[0][1] == 0  # the first of the largest
    assert got[1] == (0.0, 1) and got[2] == (0.0, 1) and got[3][0] is None
