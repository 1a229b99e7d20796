"""Batches: assignment, collation, device shards, checks and the training plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_batches(
    df: DataFrame, batch_size: int, drop_last: bool = False, total: str = "total"
) -> DataFrame:
    """Batch number and place in the batch from a zero-based ``rank``.

    Dropping a short last batch needs the number of rows that were ranked in ``total``.
    """
    placed = df.withColumns({
        "batch_id": F.floor(F.col("rank") / batch_size),
        "row_in_batch": (F.col("rank") % batch_size).cast("int"),
    })
    if not drop_last:
        return placed
    return placed.where(F.col("batch_id") < F.floor(F.col(total) / batch_size))


def collate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per batch; a group holds batch_size rows at most."""
    rows = F.array_sort(F.collect_list(F.struct("row_in_batch", *columns)))
    batches = df.groupBy(*keys, "batch_id").agg(rows.alias("__rows"))
    return batches.select(
        *keys, "batch_id", F.size("__rows").alias("n_rows"),
        *[F.col(f"__rows.{c}").alias(c) for c in columns])


def pad_batches(df: DataFrame, fills: dict[str, int], length: int | None = None) -> DataFrame:
    """Rows of collated arrays padded with the value of their column, to ``length`` or the batch's longest row.

    Rows of one place are equally long in all columns. Longer ones than ``length`` are an error.
    """
    longest = F.array_max(F.transform(F.col(next(iter(fills))), lambda r: F.size(r)))
    if length is not None:
        too_long = F.raise_error(F.concat(F.lit(f"a row is longer than {length}: "), longest.cast("string"))).cast("int")
        longest = F.when(longest > length, too_long).otherwise(F.lit(length))

    def padded(column: str, fill: int, kind: str) -> Column:
        value = F.lit(fill).cast(kind)
        return F.transform(F.col(column), lambda r: F.concat(r, F.array_repeat(value, F.col("__longest") - F.size(r))))

    kinds = {c: df.schema[c].dataType.elementType.elementType.simpleString() for c in fills}
    return df.withColumn("__longest", longest).withColumns(
        {c: padded(c, v, kinds[c]) for c, v in fills.items()}).drop("__longest")


def assign_dp_shards(df: DataFrame, batch_size: int, shards: int) -> DataFrame:
    """Contiguous blocks of each batch, one per data-parallel device."""
    if shards <= 0 or batch_size % shards:
        raise ValueError(f"batch size {batch_size} does not divide over {shards} shards")
    per_shard = batch_size // shards
    return df.withColumns({
        "dp_rank": F.floor(F.col("row_in_batch") / per_shard).cast("int"),
        "row_in_shard": (F.col("row_in_batch") % per_shard).cast("int"),
    })


def batch_shape_check(
    df: DataFrame, columns: Sequence[str], length: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per batch and the range of array lengths; ``ok`` when all are ``length``."""
    measures = [F.count(F.lit(1)).alias("n_rows")]
    good = F.lit(True)
    for c in columns:
        measures += [F.min(F.size(c)).alias(f"min_{c}"), F.max(F.size(c)).alias(f"max_{c}")]
        good = good & (F.col(f"min_{c}") == length) & (F.col(f"max_{c}") == length)
    return df.groupBy(*keys, "batch_id").agg(*measures).withColumn("ok", good)


def training_plan(
    df: DataFrame, batch_size: int, epochs: int, max_steps: int | None = None
) -> DataFrame:
    planned = df.agg(F.count(F.lit(1)).alias("samples")).withColumn(
        "steps_per_epoch", F.ceil(F.col("samples") / batch_size).cast("bigint"))
    total = F.col("steps_per_epoch") * epochs
    if max_steps:
        total = F.least(total, F.lit(max_steps).cast("bigint"))
    return planned.withColumn("total_steps", total).withColumn(
        "limited", F.col("total_steps") < F.col("steps_per_epoch") * epochs)


def dataset_stats(df: DataFrame, ids: str, tokenizer: str, keys: Sequence[str] = ()) -> DataFrame:
    size = F.size(ids)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.lit(tokenizer).alias("tokenizer"),
        F.max(size).alias("max_length"),
        F.avg(size).alias("avg_length"),
        F.percentile_approx(size, 0.5).alias("median_length"),
    )


#: Items a sketch of lengths keeps. The rank of an answer is off by about 2.3 / SKETCH_ITEMS, and RANK_ERROR is given.
SKETCH_ITEMS = 800
RANK_ERROR = 0.01


def stats_parts(df: DataFrame, length: Column, keys: Sequence[str], items: int = SKETCH_ITEMS) -> DataFrame:
    """Statistics per group that add up: one row per group to be stored, with a sketch of the lengths of bounded size."""
    length = length.cast("bigint")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.max(length).alias("max_length"),
        F.count(length).alias("measured"), F.sum(length).alias("total_length"),
        F.kll_sketch_agg_bigint(length, items).alias("lengths"))


def merge_stats(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics over any groups of parts, from the parts alone. Null lengths only count as samples."""
    median = F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("lengths"), F.lit(0.5))
    return parts.groupBy(*keys).agg(
        F.sum("samples").alias("samples"), F.max("max_length").alias("max_length"),
        F.try_divide(F.sum("total_length"), F.sum("measured")).alias("avg_length"),
        # an empty sketch has no quantiles
        F.when(F.sum("measured") > 0, median).alias("median_length"))
