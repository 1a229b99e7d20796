from __future__ import annotations

import hashlib
import math
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators.select import limit_examples, take_first, trim_to_global_batch
from tidemill.operators.split import shuffle_order, train_test_split
from tidemill.plans.order import by_hash, by_id, by_id_pair, dense_rank

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 10, 100])
def test_split_sizes_are_exact(spark, n):
    rows = train_test_split(spark.range(n), ["id"], 0.15, 42).collect()
    test = sorted(r["id"] for r in rows if r["split"] == "test")
    expected = sorted(sorted(range(n), key=lambda i: digest(42, i))[:math.ceil(0.15 * n)])
    assert len(rows) == n
    assert test == expected


def test_half_split_of_two(spark):
    splits = [r["split"] for r in train_test_split(spark.range(2), ["id"], 0.5).collect()]
    assert sorted(splits) == ["test", "train"]


@pytest.mark.parametrize("fraction, expected", [(0.0, 0), (1.0, 20)])
def test_split_extremes(spark, fraction, expected):
    df = train_test_split(spark.range(20), ["id"], fraction)
    assert df.where("split = 'test'").count() == expected


def test_split_does_not_depend_on_partitioning(spark):
    base = spark.range(500)
    once = {tuple(r) for r in train_test_split(base.repartition(1), ["id"]).collect()}
    many = {tuple(r) for r in train_test_split(base.repartition(17), ["id"]).collect()}
    assert once == many


def test_split_changes_with_the_seed(spark):
    base = spark.range(500)
    a = {tuple(r) for r in train_test_split(base, ["id"], seed=1).collect()}
    b = {tuple(r) for r in train_test_split(base, ["id"], seed=2).collect()}
    assert a != b


def test_split_moves_no_rows(spark):
    plan = train_test_split(spark.range(1000).withColumn("text", F.lit("x")), ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    main = text.split("Subquery", 1)[0]
    assert "Exchange" not in main and "Join" not in main


@SLOW
@given(st.sets(st.integers(-(2**40), 2**40), max_size=40), st.integers(0, 45), st.integers(0, 20))
def test_limit_takes_the_first_ids(spark, values, n, shift):
    df, ordering = ids(spark, values), by_id("id", (shift, shift + 3))
    assert sorted(r["id"] for r in limit_examples(df, n, ordering).collect()) == sorted(values)[:n]


def nulls_first(values):
    return sorted(values, key=lambda v: (v is not None, v or 0))


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9), st.just(-(2**63))), max_size=40),
       st.integers(0, 45), st.integers(0, 4))
def test_limit_is_exact_with_nulls_and_ties(spark, values, n, shift):
    rows = limit_examples(ids(spark, values), n, by_id("id", (shift, shift + 3)), repeated=True).collect()
    assert nulls_first(r["id"] for r in rows) == nulls_first(values)[:n]


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001, 12_000, 12_001])
def test_limit_has_no_switch(spark, n):
    rows = spark.range(30_000).select(
        F.when(F.col("id") >= 12_000, F.col("id")).alias("id"), F.col("id").alias("other"))
    kept = limit_examples(rows, n, by_id("id"), repeated=True)
    assert (kept.count(), kept.where("id is null").count()) == (n, min(n, 12_000))


def test_limit_of_equal_keys_has_to_be_said(spark):
    twice = spark.range(20).select((F.col("id") % 10).alias("id"))
    assert take_first(twice, by_id("id"), F.lit(4)).count() == 4
    with pytest.raises(Exception, match="repeated=True"):
        take_first(twice, by_id("id"), F.lit(5)).collect()


def test_limit_merges_no_rows_in_one_task(spark):
    plan = limit_examples(spark.range(1000), 10, by_id("id"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan


def test_split_of_equal_rows_is_exact(spark):
    rows = spark.range(12).select((F.col("id") % 2).alias("k"), F.lit("x").alias("t"))
    got = train_test_split(rows, ["k"], 0.3, repeated=True)
    assert got.count() == 12 and got.where("split = 'test'").count() == 4


def test_rank_with_a_null_id(spark):
    rows = dense_rank(ids(spark, [None, 5, 9]), by_id("id")).collect()
    assert {r["id"]: r["rank"] for r in rows} == {None: 0, 5: 1, 9: 2}


def test_no_limit_keeps_all(spark):
    assert limit_examples(spark.range(7), None, by_id("id")).count() == 7


@pytest.mark.parametrize("rows, limit, expected", [(100, None, 96), (100, 50, 48), (7, None, 0), (0, None, 0)])
def test_trim_to_global_batch(spark, rows, limit, expected):
    got = trim_to_global_batch(spark.range(rows), 4, 2, by_id("id"), limit).collect()
    assert sorted(r["id"] for r in got) == list(range(expected))


@SLOW
@given(st.sets(st.tuples(st.integers(0, 3), st.integers(0, 300)), min_size=1, max_size=60),
       st.integers(0, 9))
def test_pair_rank_with_a_hot_major_id(spark, pairs, shift):
    df = spark.createDataFrame(sorted(pairs), "conv bigint, turn bigint").repartition(3)
    got = {(r["conv"], r["turn"]): r["rank"] for r in
           dense_rank(df, by_id_pair("conv", "turn", (shift, shift + 2))).collect()}
    assert got == {p: i for i, p in enumerate(sorted(pairs))}


def test_hash_rank_is_a_permutation_per_key(spark):
    df = spark.range(300).withColumn("epoch", (F.col("id") % 3).cast("int"))
    ranked = dense_rank(df, by_hash(["id"], 7, F.col("epoch")), keys=["epoch"]).collect()
    for epoch in range(3):
        mine = [r for r in ranked if r["epoch"] == epoch]
        order = [r["id"] for r in sorted(mine, key=lambda r: r["rank"])]
        assert sorted(r["rank"] for r in mine) == list(range(100))
        assert order == sorted(order, key=lambda i: digest(7, epoch, i))


def test_rank_handles_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id bigint")
    ranked = dense_rank(df, by_id("id", (0, 1)), keys=["k"]).collect()
    assert sorted((r["k"] or "", r["id"], r["rank"]) for r in ranked) == [
        ("", 1, 0), ("", 2, 1), ("a", 3, 0)]


def test_shuffle_differs_per_epoch_and_can_be_off(spark):
    df = spark.range(50)

    def order(**kw):
        rows = shuffle_order(df, by_id("id"), ["id"], 42, **kw).collect()
        return [r["id"] for r in sorted(rows, key=lambda r: r["rank"])]

    assert order(enabled=False) == list(range(50))
    assert order(epoch=0) != order(epoch=1)
    assert order(epoch=1) == order(epoch=1)


def test_epoch_places_are_permutations(spark):
    from tidemill.operators.split import epoch_place, shuffle_ranked
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 97, 1000)], "total bigint")
    ranked = sizes.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)))
    orders = {}
    for epoch in (0, 1):
        for r in shuffle_ranked(ranked, 42, epoch).collect():
            orders.setdefault((r["total"], epoch), {})[r["rank"]] = r["place"]
    for (total, epoch), places in orders.items():
        assert sorted(places.values()) == list(range(total))
        if total >= 97:
            assert sum(places[i] == i for i in places) < 8 and places != orders[total, 1 - epoch]
            near = sum(abs(places[i] - places[i + 1]) <= total // 20 for i in range(total - 1))
            assert near < 0.25 * total  # neighbours part
    huge = spark.range(1).select(epoch_place(F.lit(2**61 - 5), 2**61, 7, 3).alias("p")).first()["p"]
    assert 0 <= huge < 2**61
    assert "Exchange" not in shuffle_ranked(ranked.drop("x"), 42, 1)._jdf.queryExecution().executedPlan().toString()


def test_epoch_places_of_many_rows(spark):
    """Tens of thousands of rows in seconds; a null rank has no place, and epochs may differ from row to row."""
    from tidemill.operators.split import epoch_place
    n = 400_000
    rows = spark.range(n).select("id", epoch_place(F.col("id"), n, 42, F.col("id") % 2).alias("p"))
    begun = time.monotonic()
    ends = rows.groupBy(F.col("id") % 2).agg(F.min("p"), F.max("p"), F.count_distinct("p")).collect()
    assert time.monotonic() - begun < 60
    assert all(0 <= r[1] < n // 100 and n - n // 100 < r[2] < n and r[3] == n // 2 for r in ends)
    odd = spark.createDataFrame([(0, None, 5), (1, 3, None), (2, 3, 5), (3, 3, 1 << 40)], "id int, rank bigint, n bigint")
    places = {r["id"]: r["p"] for r in odd.select("id", epoch_place(F.col("rank"), F.col("n"), 1).alias("p")).collect()}
    assert places[0] is None and places[1] is None and 0 <= places[2] < 5 and 0 <= places[3] < 1 << 40
