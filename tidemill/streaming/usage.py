"""Usage events as they come in: counts, sessions, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.events import tumbling_counts


def windowed_counts(stream: DataFrame, width: str, watermark: str) -> DataFrame:
    """Counts of windows that the watermark has closed; later events are dropped."""
    return tumbling_counts(stream, width, watermark=watermark)


def sessions(
    stream: DataFrame, gap: str, watermark: str, user: str = "user_id", ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Closed sessions. ``merge_locally`` should be on for users with very many events."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(user, F.session_window(ts, gap).alias("__w"))
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_event"),
             F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"))
        .select(user, "session_start", "last_event", "n_events", "total_value")
    )


# Sessions are merged before the shuffle, so a busy user is spread over the input tasks.
MERGE_LOCALLY = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def dedup_stream(
    stream: DataFrame, key: str, watermark: str, ts: str = "ts", spread: int = 8
) -> DataFrame:
    """Each key once, for repeats that arrive within the watermark.

    Repeats of one key would all go to one task. They are dropped in two steps: first per
    key and group of input tasks, then per key, where at most ``spread`` of them are left.
    With ``spread`` 1 there is only the second step, and half the state.
    """
    timed = stream.withWatermark(ts, watermark)
    if spread > 1:
        timed = timed.withColumn("__task", F.spark_partition_id() % spread)
        timed = timed.dropDuplicatesWithinWatermark([key, "__task"]).drop("__task")
    return timed.dropDuplicatesWithinWatermark([key])
