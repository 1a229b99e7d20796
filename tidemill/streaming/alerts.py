"""Cost alerts while the usage is still coming in.

Rows wait until the watermark, the largest time seen less a delay, has passed them; then they are added to their user's
month in order of time, by the operator that works on whole tables, so a busy user's rows are spread here too. What has
been spent per user and month is a change table, so a batch writes the totals of its own users only. A row that comes
after the watermark has passed it is added on arrival: no cost is lost, and an alert that it sets off is marked ``late``.
Totals of a month only grow, so each threshold is reached once.

A batch writes its alerts and its waiting rows below its own number and then counts from the moment the change table
names it. A batch that fails before is run again over the same input and writes the same; one that fails after is skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.billing import TOTAL, cost_alerts
from tidemill.sources import shared_files
from tidemill.streaming.runs import run_batches
from tidemill.streaming.upsert import ChangeTable


class AlertState:
    """What lies below ``folder``: alerts per batch, rows that wait, the largest time, and totals."""

    def __init__(
        self, spark: SparkSession, folder: str, stream: str, thresholds: Sequence[float], limit: float | None,
        delay_seconds: int, user: str, ts: str, job: str,
    ) -> None:
        self.spark, self.folder, self.stream = spark, folder.rstrip("/"), stream
        self.thresholds, self.limit, self.delay_us = thresholds, limit, delay_seconds * 1_000_000
        self.user, self.ts, self.job = user, ts, job
        self.totals = ChangeTable(spark, f"{self.folder}/totals", "id", "batch")

    def waiting(self, batch_id: int) -> str:
        return f"{self.folder}/waiting/{batch_id}"

    def seen(self, batch_id: int) -> str:
        return f"{self.folder}/seen/{batch_id}"

    def add(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.totals.manifest().last_batch.get(self.stream, -1):
            return
        user, ts = self.user, self.ts
        came = batch.select(user, ts, self.job, F.col("cost").cast(TOTAL).alias("cost"))
        times, before = came.select(F.unix_micros(ts).alias("us")), None
        if batch_id:
            old = self.spark.read.schema("us bigint").parquet(self.seen(batch_id - 1))
            before = old.first()["us"]
            times = times.unionByName(old)
            came = came.unionByName(self.spark.read.schema(came.schema).parquet(self.waiting(batch_id - 1)))
        times.agg(F.max("us").alias("us")).write.mode("overwrite").parquet(self.seen(batch_id))
        latest = self.spark.read.schema("us bigint").parquet(self.seen(batch_id)).first()["us"]
        at = F.unix_micros(ts)
        # a null where no row had a time yet: then nothing is over, and no row has a place
        over = at <= F.lit(None if latest is None else latest - self.delay_us).cast("bigint")
        priced = came.where(F.col("cost").isNotNull() & F.col(ts).isNotNull())
        priced.where(~over).write.mode("overwrite").parquet(self.waiting(batch_id))
        closed = priced.where(over)

        id_type = f"struct<who:{came.schema[user].dataType.simpleString()},month:string>"
        schema = self.spark.range(0).select(
            F.lit(None).cast(id_type).alias("id"), F.lit(None).cast(TOTAL).alias("total"),
            F.lit(None).cast("bigint").alias("batch")).schema
        opening = self.totals.read(schema).select(
            F.col("id.who").alias(user), F.col("id.month").alias("month"), "total")
        passed = F.lit(None if before is None else before - self.delay_us).cast("bigint")
        cost_alerts(closed, self.thresholds, self.limit, user, ts, self.job, opening).withColumn(
            "late", F.coalesce(at <= passed, F.lit(False))
        ).write.mode("overwrite").parquet(f"{self.folder}/alerts/batch={batch_id}")

        spent = closed.groupBy(user, F.date_format(ts, "yyyy-MM").alias("month")).agg(
            F.sum("cost").cast(TOTAL).alias("spent"))
        known = opening.select(F.col(user).alias("__who"), F.col("month").alias("__month"), "total")
        grown = spent.join(
            known, F.col(user).eqNullSafe(F.col("__who")) & (F.col("month") == F.col("__month")), "left")
        self.totals.add(grown.select(
            F.struct(F.col(user).alias("who"), "month").cast(id_type).alias("id"),
            (F.col("spent") + F.coalesce("total", F.lit(0))).cast(TOTAL).alias("total"),
            F.lit(batch_id).cast("bigint").alias("batch")), self.stream, batch_id)
        for old_path in (self.waiting(batch_id - 2), self.seen(batch_id - 2)):
            if batch_id >= 2:
                shared_files.delete(self.spark, old_path)


def stream_cost_alerts(
    costs: DataFrame, folder: str, checkpoint: str, thresholds: Sequence[float], limit: float | None = None,
    delay_seconds: int = 3600, user: str = "user_id", ts: str = "ts", job: str = "event_id",
) -> None:
    """Process the costs that are there so far; alerts go below ``folder``, one stream per folder.

    Rows without a cost or a time set off nothing, as in ``cost_alerts``. Rows of the last ``delay_seconds`` still wait.
    """
    state = AlertState(
        costs.sparkSession, folder, checkpoint, thresholds, limit, delay_seconds, user, ts, job)
    run_batches(costs, state.add, checkpoint)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts of finished and running batches; ``batch`` says which one gave them."""
    return spark.read.option("basePath", f"{folder.rstrip('/')}/alerts").parquet(f"{folder.rstrip('/')}/alerts")
