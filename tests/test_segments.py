from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.plans.segments import by_shift, running_sum, scan_keys

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
ROWS = st.dictionaries(
    st.tuples(st.sampled_from(["hot", "hot", "b", None]), st.integers(-50, 400)),
    st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=50)


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, t, v) for (k, t), v in rows.items()], "k string, t bigint, v bigint").repartition(3)


def collected(df, *columns):
    return {(r["k"], r["t"]): tuple(r[c] for c in columns) for r in df.collect()}


@SLOW
@given(ROWS, st.integers(0, 8))
def test_scan_equals_plain_windows(spark, rows, shift):
    df = frame(spark, rows)
    got = scan_keys(
        df, keys=["k"], order="t", shift=shift, previous={"p": F.col("t"), "q": F.col("v")},
        following={"f": F.col("t"), "g": F.col("v")},
        held={"h": F.col("v")}, sums={"s": F.coalesce("v", F.lit(0))})
    w = Window.partitionBy("k").orderBy("t")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select(
        "*", F.lag("t").over(w).alias("p"), F.lag("v").over(w).alias("q"),
        F.lead("t").over(w).alias("f"), F.lead("v").over(w).alias("g"),
        F.last("v", ignorenulls=True).over(running).alias("h"),
        F.sum(F.coalesce("v", F.lit(0))).over(running).alias("s"))
    columns = ("v", "p", "q", "f", "g", "h", "s")
    assert collected(got, *columns) == collected(want, *columns)


@SLOW
@given(ROWS, st.integers(0, 4), st.integers(1, 5))
def test_running_sum_over_several_levels(spark, rows, first, step):
    df = frame(spark, rows)
    got = running_sum(
        df, F.coalesce("v", F.lit(0)), "s", keys=["k"], order=["t"],
        levels=by_shift("t", first, first + step))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w))
    assert collected(got, "s") == collected(want, "s")


def test_scan_replaces_a_column_of_the_same_name(spark):
    df = frame(spark, {("a", 1): 5, ("a", 2): None})
    got = scan_keys(df, keys=["k"], order="t", shift=0, held={"v": F.col("v")})
    assert got.columns == ["k", "t", "v"]
    assert collected(got, "v") == {("a", 1): (5,), ("a", 2): (5,)}


def test_collected_stays_in_its_segment(spark):
    df = frame(spark, {("a", t): t for t in range(5)})
    got = collected(scan_keys(df, keys=["k"], order="t", shift=1, collected={"c": F.col("v")}), "c")
    assert got == {("a", 0): ([],), ("a", 1): ([0],), ("a", 2): ([],), ("a", 3): ([2],), ("a", 4): ([],)}


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(4096).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scanned = scan_keys(df, keys=["k"], order="t", shift=6, sums={"s": F.col("v")})
        tasks = scanned.groupBy(F.spark_partition_id().alias("p")).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1
