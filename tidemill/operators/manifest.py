"""Shard manifests: range joins, copy and cleanup plans, last-wins merges, name rules."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.catalog import age
from tidemill.session import settings_table

# Inclusive shard ranges (worker, first, last).
WORKER_RANGES = (
    (0, 1, 4), (1, 4, 8), (2, 8, 12), (3, 12, 15),
    (4, 16, 19), (5, 19, 23), (6, 23, 27), (7, 27, 30),
)
# Model parameter names and the axes they are sharded over, in order.
PARAMETER_RULES = (
    ("transformer/wte/embedding", "mp,fsdp"),
    ("attention/(wq|wk|wv)/kernel", "fsdp,mp"),
    ("attention/wo/kernel", "mp,fsdp"),
    ("feed_forward/w1/kernel", "fsdp,mp"),
    ("feed_forward/w2/kernel", "mp,fsdp"),
    ("feed_forward/w3/kernel", "fsdp,mp"),
    ("attention_norm/kernel", ""),
    ("ffn_norm/kernel", ""),
    ("transformer/ln_f/kernel", ""),
    ("lm_head/kernel", "fsdp,mp"),
    ("batch_stats/.*", "dp"),
    (".*lora_a", "fsdp,mp"),
    (".*lora_b", "mp,fsdp"),
    (".*", ""),
)


def range_table(
    spark: SparkSession, ranges: Sequence[tuple[int, int, int]] = WORKER_RANGES
) -> DataFrame:
    return settings_table(
        spark, ranges, {"worker": pa.int32(), "lo": pa.int32(), "hi": pa.int32()})


#: Levels of cells: one of level i holds 2**i values. Ranges of up to 2**62 values are cut into whole cells.
TOP_LEVEL = 62
#: Groups that the ranges of one cell are spread over, so that a busy cell is not one task's.
SPREAD = 8


def dyadic_cells(lo: Column, hi: Column) -> Column:
    """Whole cells, as (level, cell), that make up the range from ``lo`` to ``hi``: two of each level at most.

    The smallest cells come from both ends: a cell of a level is taken where the range does not go on
    with its sibling, until nothing is left. Cell ``c`` of level ``i`` is the values ``c << i`` to ``((c + 1) << i) - 1``.
    """
    cell = "struct<level:int,cell:bigint>"
    state = F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"),
                     F.array().cast(f"array<{cell}>").alias("cells"))

    def take(when: Column, level: Column, at: Column) -> Column:
        made = F.array(F.struct(level.cast("int").alias("level"), at.alias("cell")).cast(cell))
        return F.when(when, made).otherwise(F.array().cast(f"array<{cell}>"))

    def step(acc: Column, level: Column) -> Column:
        low, high = acc["lo"], acc["hi"]
        inside = low <= high
        left = inside & (low.bitwiseAND(F.lit(1)) == 1)
        right = inside & (high.bitwiseAND(F.lit(1)) == 0) & ~(left & (low == high))
        return F.struct(
            F.when(inside, F.shiftright(low, 1) + F.when(left, 1).otherwise(0)).otherwise(low).alias("lo"),
            F.when(inside, F.shiftright(high, 1) - F.when(right, 1).otherwise(0)).otherwise(high).alias("hi"),
            F.concat(acc["cells"], take(left, level, low), take(right, level, high)).alias("cells"))

    levels = F.sequence(F.lit(0), F.lit(TOP_LEVEL))
    return F.aggregate(levels, state, step, lambda acc: acc["cells"])


def range_join(points: DataFrame, ranges: DataFrame, point: str, spread: int = SPREAD) -> DataFrame:
    """Points with the inclusive ranges of integers they lie in.

    A range is cut into dyadic cells, at most two for each power of two of its width. A point has one cell on
    each level that occurs, so this is an equality join on (level, cell), and every pair it gives is right: a point
    lies in one cell of a range at most, and a cell in its range whole. Points of one cell are spread by a hash, and the cell's
    ranges copied to these groups.
    """
    marks = ["__level", "__cell", "__group"]
    cells = ranges.withColumn("__c", F.explode(dyadic_cells(F.col("lo"), F.col("hi"))))
    cut = cells.select(*[F.col(f"`{c}`") for c in ranges.columns], F.col("__c.level").alias("__level"),
                       F.col("__c.cell").alias("__cell"),
                       F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__group"))
    used = ranges.select(F.explode(dyadic_cells(F.col("lo"), F.col("hi"))).alias("__c")).agg(
        F.array_sort(F.collect_set("__c.level")).alias("levels"))  # 63 at most
    placed = points.withColumn("__level", F.explode(used.scalar())).withColumns({
        "__cell": F.call_function("shiftright", F.col(point).cast("bigint"), F.col("__level")),
        "__group": F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.lit(spread)).cast("int")})
    return placed.join(cut, marks).drop(*marks)


def assign_shards(shards: DataFrame, ranges: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, worker) pairs; ranges that overlap give a shard to both workers."""
    return range_join(shards, ranges, shard).drop("lo", "hi")


def copy_plan(
    shards: DataFrame, ranges: DataFrame, present: DataFrame, shard: str = "shard",
    key: Sequence[str] = ("worker", "shard"),
) -> DataFrame:
    """Assigned files that a worker does not have yet."""
    return assign_shards(shards, ranges, shard).join(
        present.select(*key), list(key), "left_anti")


def shard_number(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"[0-9]+", 0).try_cast("int")


def cleanup_plan(
    present: DataFrame, ranges: DataFrame, file_name: str = "file_name"
) -> DataFrame:
    """Files on a worker whose number lies outside the worker's range."""
    numbered = present.withColumn("shard", shard_number(F.col(file_name)))
    joined = numbered.join(ranges, "worker")
    return joined.where(~F.col("shard").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def merge_last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Value of the latest shard per key; of several values with one order the largest."""
    last = F.max_by(F.struct(value, order), F.struct(age(order), F.col(value)))
    return df.groupBy(key).agg(last.alias("__last")).select(
        key, F.col(f"__last.{value}").alias(value), F.col(f"__last.{order}").alias(order))


def first_match_rule(
    df: DataFrame, rules: Sequence[tuple[str, str]], column: str, exempt: Column | None = None,
    out: str = "spec",
) -> DataFrame:
    """Outcome of the first pattern found in the name; null where none is.

    Rules are configuration, so they become one chain of conditions that is evaluated
    row by row until a pattern matches; no join is involved. ``exempt`` rows get the
    empty outcome.
    """
    chain = F.when(exempt, F.lit("")) if exempt is not None else None
    for pattern, spec in rules:
        hit = F.regexp_like(column, F.lit(pattern))
        chain = F.when(hit, F.lit(spec)) if chain is None else chain.when(hit, F.lit(spec))
    return df.withColumn(out, chain)


def unmatched(df: DataFrame, out: str = "spec") -> DataFrame:
    return df.where(F.col(out).isNull())
