"""Counts of windows, and the events that come after their window was closed.

A window is closed when the watermark passes its end, and then counted once. What comes later is not dropped but put
out as a correction to the window, at once. So counts and corrections add up to the count of all events, whatever
order they came in, and a consumer may use the counts as they are or add the corrections at any later time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

COUNT = StructType([StructField("n", LongType())])
OUTPUT = "start_us bigint, event string, kind string, n bigint"
CLOSED, LATE = "closed", "late"
#: Keys that the events of one window and name are spread over.
SPREAD = 8


class CountUntilClosed(StatefulProcessor):
    """Per window, name and share of it: a count, a timer for the window's end, and whether that is over."""

    def __init__(self, width_us: int) -> None:
        self.width_us = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", COUNT)

    def _row(self, key, kind: str, n: int) -> pd.DataFrame:
        return pd.DataFrame({"start_us": [key[0]], "event": [key[1]], "kind": [kind], "n": [n]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(pdf) for pdf in rows)
        end_ms = -(-(key[0] + self.width_us) // 1000)
        if end_ms <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, LATE, n)
            return
        held = self.count.get()
        if held is None:
            self.handle.registerTimer(end_ms)
        self.count.update((n + (0 if held is None else held[0]),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.count.get()
        self.count.clear()
        yield self._row(key, CLOSED, int(held[0]))

    def close(self) -> None:
        pass


def counts_and_corrections(
    stream: DataFrame, width_seconds: int, watermark: str, ts: str = "ts", event: str = "event_type",
    identity: str = "event_id", spread: int = SPREAD,
) -> DataFrame:
    """Columns window_start, event, kind, n: ``closed`` counts and ``late`` corrections, to be summed up.

    ``spread`` keys share a window and name, by a hash of ``identity``, so a busy one is not one task's; each gives
    rows of its own. The state of a window lasts until it is closed.
    """
    width = width_seconds * 1_000_000
    start = F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(width))
    # without the column of the watermark the rows are not filtered by it
    keyed = stream.withWatermark(ts, watermark).select(
        start.alias("start_us"), F.col(event).alias("event"),
        F.pmod(F.xxhash64(identity), F.lit(spread)).alias("share"))
    counted = keyed.groupBy("start_us", "event", "share").transformWithStateInPandas(
        statefulProcessor=CountUntilClosed(width), outputStructType=OUTPUT, outputMode="append",
        timeMode="eventtime")
    return counted.select(F.timestamp_micros("start_us").alias("window_start"), F.col("event").alias(event), "kind", "n")


def corrected(rows: DataFrame, event: str = "event_type") -> DataFrame:
    """Counts of closed windows with all corrections so far, and how many came late."""
    return rows.groupBy("window_start", event).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == LATE, F.col("n"))), F.lit(0)).alias("n_late"))
