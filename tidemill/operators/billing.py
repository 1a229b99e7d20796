"""Costs in decimals, breakdowns, periods and alerts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.text import micros
from tidemill.plans.segments import running_sum
from tidemill.session import settings_table

MONEY = "decimal(18,6)"
# Wide enough for a sum over every row of a very large table.
TOTAL = "decimal(38,6)"
# 2**28 microseconds, about four and a half minutes.
STRETCH_SHIFT = 28


def pricing_table(spark: SparkSession, rows: Sequence[tuple[str, float, int]]) -> DataFrame:
    return settings_table(spark, rows, {
        "gpu_type": pa.string(), "cost_per_hour": pa.float64(), "min_billing_seconds": pa.int32()})


def job_cost(
    usage: DataFrame, pricing: DataFrame, minimum: bool = False, key: str = "gpu_type",
    seconds: str = "duration_seconds",
) -> DataFrame:
    """Cost of each usage row; ``minimum`` bills at least the price list's seconds."""
    rate = F.col("cost_per_hour").cast("decimal(12,4)")
    priced = usage.join(pricing, key, "left")
    billed = F.greatest(F.col(seconds), F.col("min_billing_seconds")) if minimum else F.col(seconds)
    return priced.withColumn("billed_seconds", billed.cast("bigint")).withColumn(
        "cost", (F.col("billed_seconds").cast("decimal(16,0)") * rate / 3600).cast(MONEY))


def usage_breakdown(costs: DataFrame, user: str = "user_id", key: str = "gpu_type") -> DataFrame:
    """Seconds, rate and cost per user and type."""
    return costs.groupBy(user, key).agg(
        F.sum("billed_seconds").alias("seconds"),
        F.max("cost_per_hour").alias("cost_per_hour"),
        F.sum("cost").cast(TOTAL).alias("total_cost"))


def breakdown_map(breakdown: DataFrame, user: str = "user_id", key: str = "gpu_type") -> DataFrame:
    """The breakdown as one map per user; the price list bounds its entries."""
    entry = F.struct(F.col(key), F.struct("seconds", "cost_per_hour", "total_cost"))
    return breakdown.groupBy(user).agg(
        F.map_from_entries(F.collect_list(entry)).alias("usage_breakdown"))


def billing_rollup(costs: DataFrame, ts: str = "ts", key: str = "gpu_type") -> DataFrame:
    """Totals per month and type, per month, and overall; ``level`` tells which."""
    # Summed up before the rollup, which copies its input once per level.
    finest = costs.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), key).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("billed_seconds").alias("__s"),
        F.sum("cost").cast(TOTAL).alias("__c"))
    return finest.rollup("month", key).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("__n").alias("n_jobs"),
        F.sum("__s").alias("seconds"),
        F.sum("__c").cast(TOTAL).alias("total_cost"))


def cost_alerts(
    costs: DataFrame, thresholds: Sequence[float], limit: float | None = None,
    user: str = "user_id", ts: str = "ts", job: str = "event_id", opening: DataFrame | None = None,
) -> DataFrame:
    """The usage row at which a user's running cost of a month reaches each threshold.

    Totals per day, at most 31 per user and month, tell on which days thresholds are
    crossed. Only the rows of those days are put in order, in short stretches of time, so
    that a busy user's day is not one task. ``stop`` marks the spending limit. ``opening`` has, in the columns of
    the user, ``month`` and ``total``, what was spent before these rows; thresholds up to it were reached before.
    """
    values = sorted({*thresholds, *([limit] if limit is not None else [])})
    marks = F.array(*[F.lit(v).cast(TOTAL) for v in values])

    def crossed(upto: Column, step: Column) -> Column:
        return F.filter(marks, lambda m: (m <= upto) & (m > upto - step))

    rows = costs.where(F.col("cost").isNotNull()).select(
        user, F.col(ts).alias("__ts"), F.col(job).alias("__job"), "cost",
        F.date_format(ts, "yyyy-MM-dd").alias("__day"))
    month = F.substring("__day", 1, 7)
    per_day = rows.groupBy(user, "__day").agg(F.sum("cost").cast(TOTAL).alias("__c"))
    opened = F.lit(0)
    if opening is not None:
        totals = opening.select(
            F.col(user).alias("__owner"), F.col("month").alias("__month"), F.col("total").alias("__open"))
        per_day = per_day.join(
            totals, F.col(user).eqNullSafe(F.col("__owner")) & (month == F.col("__month")), "left")
        opened = F.coalesce("__open", F.lit(0))
    running = Window.partitionBy(user, month).orderBy("__day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    days = (
        per_day.withColumn("__upto", (F.sum("__c").over(running) + opened).cast(TOTAL))
        .where(F.size(crossed(F.col("__upto"), F.col("__c"))) > 0)
        .select(F.col(user).alias("__user"), F.col("__day").alias("__on"),
                (F.col("__upto") - F.col("__c")).alias("__before"))
    )
    inside = rows.join(
        days, F.col(user).eqNullSafe(F.col("__user")) & (F.col("__day") == F.col("__on"))
    ).select(*rows.columns, "__before")
    stretch = {"__stretch": F.shiftright(micros(F.col("__ts")), STRETCH_SHIFT)}
    summed = running_sum(
        inside, F.col("cost").cast(TOTAL), "__sum", keys=[user, "__day"], order=["__ts", "__job"],
        levels=[stretch]).withColumn("running_cost", (F.col("__before") + F.col("__sum")).cast(TOTAL))
    hits = summed.withColumn(
        "threshold", F.explode(crossed(F.col("running_cost"), F.col("cost"))))
    stop = F.lit(False) if limit is None else F.col("threshold") >= F.lit(limit).cast(TOTAL)
    return hits.select(
        user, month.alias("month"), "threshold", F.col("__ts").alias(ts), F.col("__job").alias(job),
        "running_cost", stop.alias("stop"))
