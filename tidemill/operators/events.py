"""Usage events: properties, windows, sessions and failure reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import micros



def parse_events(
    df: DataFrame, schema: str, user: str = "user_id", props: str = "props"
) -> DataFrame:
    """Typed properties, and a name for users that are not logged in."""
    return df.withColumns({
        user: F.coalesce(F.col(user).cast("string"), F.lit("anonymous")),
        props: F.from_json(props, schema),
    })


def tumbling_counts(
    df: DataFrame, width: str, ts: str = "ts", event: str = "event_type",
    watermark: str | None = None,
) -> DataFrame:
    """Events per window and name; the same plan serves tables and streams."""
    timed = df if watermark is None else df.withWatermark(ts, watermark)
    return (
        timed.groupBy(F.window(ts, width).alias("__w"), event)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"),
                event, "n")
    )


def sliding_avg(
    df: DataFrame, slides: int, slide_seconds: int, value: str = "value", ts: str = "ts",
    event: str = "event_type",
) -> DataFrame:
    """Averages over windows of ``slides`` slides, one starting with every slide.

    Values are summed up in their own type, exactly for decimals. Rows are summed up per slide first; only those sums are copied into the windows that
    overlap them, not the rows.
    """
    step = slide_seconds * 1_000_000
    slot = F.floor(micros(F.col(ts)) / step)
    per_slot = df.groupBy(event, slot.alias("__slot")).agg(
        F.count(value).alias("__n"), F.sum(value).alias("__s"))
    spread = per_slot.withColumn("__first", F.explode(F.sequence(
        F.col("__slot") - (slides - 1), F.col("__slot"))))
    return spread.groupBy(event, "__first").agg(
        F.sum("__n").alias("n"), F.sum("__s").alias("__s"),
    ).select(
        F.timestamp_micros(F.col("__first") * step).alias("window_start"),
        event, "n", (F.col("__s").cast("double") / F.col("n")).alias("avg_value"))


def session_events(
    df: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Runs of a user's events with less than ``gap_seconds`` between neighbours.

    Events in the same gap-wide slot always belong together, so slots are aggregated first
    (before the shuffle); sessions are then found on at most one row per user and slot.
    """
    gap = gap_seconds * 1_000_000
    at = micros(F.col(ts))
    slots = df.select(user, at.alias("__at"), F.col(value).alias("__v")).groupBy(
        user, F.floor(F.col("__at") / gap).alias("__slot")
    ).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"),
          F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"))
    along = Window.partitionBy(user).orderBy("__slot")
    fresh = F.coalesce(F.col("__lo") - F.lag("__hi").over(along) >= gap, F.lit(True))
    numbered = slots.withColumn("__new", fresh.cast("int")).withColumn(
        "session_no", F.sum("__new").over(
            along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(user, "session_no").agg(
        F.timestamp_micros(F.min("__lo")).alias("session_start"),
        F.timestamp_micros(F.max("__hi")).alias("last_event"),
        F.sum("__n").alias("n_events"),
        F.sum("__s").alias("total_value"))


def failure_breakdown(
    df: DataFrame, failed: Column, reason: Column, event: str = "event_type"
) -> DataFrame:
    """Failures by event name and reason, with subtotals."""
    # Counted before the rollup, which copies its input once per level.
    finest = df.where(failed).groupBy(
        event, F.coalesce(reason, F.lit("unknown")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("__n"))
    return finest.rollup(event, "reason").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("__n").alias("n"))
