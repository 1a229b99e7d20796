"""Streams over the given tables, run until all input is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.queries.events import LIMIT, MICRO_STAMP, MINIMUM, THRESHOLDS, costs, stamp
from tidemill.queries.files import NUMBERED, file_name, log_lines
from tidemill.queries.registry import query
from tidemill.session import scratch_dir, settings, table
from tidemill.sources import byte_ranges, logs
from tidemill.streaming import alerts, late, lifecycle, runs, upsert, usage

WATERMARK = "1 hour"
SECONDS = "yyyy-MM-dd HH:mm:ss"
MILLI_STAMP = "yyyy-MM-dd HH:mm:ss.SSS"


def stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return runs.event_stream(spark, sf, schema, "events.parquet")


def results(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    out = scratch_dir(spark, label)
    # A state partition per core at most; a stream keeps this number for its whole life.
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                     spark.sparkContext.defaultParallelism)
    with settings(spark, {"spark.sql.shuffle.partitions": str(partitions)}):
        runs.run_to_files(df, out, scratch_dir(spark, f"{label}-checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS n
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    counts = usage.windowed_counts(stream(spark, sf), "1 hour", WATERMARK)
    return results(spark, counts, "tumbling").select(
        stamp("window_start"), stamp("window_end"), "event_type", "n")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event, count(*) AS n_events,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    with settings(spark, usage.MERGE_LOCALLY):
        closed = results(spark, usage.sessions(
            stream(spark, sf).withColumn("value", F.col("value").cast("decimal(38,2)")), "6 hours", WATERMARK), "sessions")
    return closed.select(
        "user_id", stamp("session_start", MICRO_STAMP), stamp("last_event", MICRO_STAMP), "n_events",
        F.col("total_value").cast("double").alias("total_value"))


@query(f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL""")
def stream_late_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events come in no order, in four batches; what is too late for its window is added to it."""
    folder = scratch_dir(spark, "shuffled")
    events = table(spark, sf, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    shuffled = runs.event_stream(spark, folder, events.schema, files_per_trigger=1)
    with settings(spark, lifecycle.STATE_STORE):
        counts = results(spark, late.counts_and_corrections(shuffled, 86400, WATERMARK), "late")
    return late.corrected(counts).select(stamp("window_start"), "event_type", "n")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is sent twice."""
    twice = stream(spark, sf).unionByName(stream(spark, sf))
    return results(spark, usage.dedup_stream(twice, "event_id", WATERMARK), "dedup").select(
        "event_id", "user_id", "event_type")


@query("""SELECT user_id AS id, event_type AS status, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    changes = stream(spark, sf).select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    target = scratch_dir(spark, "upsert")
    upsert.stream_upsert(changes, target, scratch_dir(spark, "upsert-checkpoint"), "id", "seq")
    return upsert.current(spark, target, changes.schema, "id", "seq")


@query(f"""WITH {MINIMUM}, run AS (SELECT *, strftime(ts, '%Y-%m') AS month, sum(micros) OVER (
    PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM costs),
marks(threshold, stop) AS (VALUES (500000, false), (1000000, false), (2500000, false), (5000000, true))
SELECT user_id, month, threshold::DOUBLE / 1000000 AS threshold, event_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, upto::DOUBLE / 1000000 AS running_cost, stop, false AS late
FROM run JOIN marks ON upto >= threshold AND upto - micros < threshold
WHERE ts <= (SELECT max(ts) - INTERVAL 12 HOUR FROM costs)""")
def stream_cost_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Usage comes in four parts, each event up to 12 hours after its time and so out of order."""
    rows = costs(spark, sf, minimum=True).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "cost")
    came = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(12 * 3600 * 1_000_000))
    first, last = rows.agg(F.min(came), F.max(came)).first()
    folder, out, checkpoint = (scratch_dir(spark, f"alerts-{x}") for x in ("usage", "out", "checkpoint"))
    for part in range(4):
        low, high = (first + (last + 1 - first) * n // 4 for n in (part, part + 1))
        rows.where((came >= low) & (came < high)).write.mode("append").parquet(folder)
        alerts.stream_cost_alerts(runs.event_stream(spark, folder, rows.schema), out, checkpoint, THRESHOLDS, LIMIT,
                                  delay_seconds=12 * 3600)
    return alerts.alerts(spark, out).select(
        "user_id", "month", F.col("threshold").cast("double").alias("threshold"), "event_id",
        stamp("ts", MICRO_STAMP), F.col("running_cost").cast("double").alias("running_cost"), "stop", "late")


@query(f"""WITH closed AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS job_id, event_type,
    date_trunc('millisecond', ts) AS ts FROM events
    WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED}),
jobs AS (SELECT job_id, min(ts) AS started, min(CASE WHEN event_type = 'purchase' THEN ts END) AS done
  FROM closed GROUP BY job_id),
ended AS (SELECT job_id, started, CASE WHEN done <= started + INTERVAL 3 HOUR THEN 'finished'
    WHEN started + INTERVAL 3 HOUR <= {CLOSED} THEN 'timeout' END AS outcome, done FROM jobs)
SELECT job_id, outcome, strftime(started, '%Y-%m-%d %H:%M:%S.%g') AS started,
  strftime(CASE WHEN outcome = 'finished' THEN done ELSE started + INTERVAL 3 HOUR END,
    '%Y-%m-%d %H:%M:%S.%g') AS ended FROM ended WHERE outcome IS NOT NULL""")
def stream_job_timeout(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events of one day are a job, and a purchase completes it."""
    jobs = stream(spark, sf).withColumn(
        "job_id", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    with settings(spark, lifecycle.STATE_STORE):
        ended = results(spark, lifecycle.stream_lifecycle(
            jobs, F.col("event_type") == "purchase", WATERMARK), "lifecycle")
    return ended.select("job_id", "outcome", stamp("started", MILLI_STAMP), stamp("ended", MILLI_STAMP))


@query("SELECT event_id || ' ' || event_type || ' ' || props AS value FROM events")
def stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of log segments that were rolled into a folder."""
    folder = scratch_dir(spark, "segments")
    log_lines(spark, sf).select("value").write.text(folder)
    return results(spark, logs.stream_log(spark, folder), "log").select("value")


@query(NUMBERED + "SELECT file, line_start AS start_byte, end_byte, value FROM numbered")
def stream_growing_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log file per user that grows between two runs; the second goes on where the first one stopped."""
    lines = log_lines(spark, sf)
    folder, out, checkpoint = (scratch_dir(spark, f"growing-{x}") for x in ("log", "lines", "checkpoint"))
    middle = F.lit(lines.agg(F.expr("floor((min(line_no) + max(line_no)) / 2)")).first()[0])
    for part in (lines.where(F.col("line_no") <= middle), lines):
        byte_ranges.write_lines(part, folder)
        runs.run_to_files(byte_ranges.stream_lines(spark, folder, range_bytes=1 << 20), out, checkpoint)
    return spark.read.schema("file string, start_byte bigint, end_byte bigint, value string").parquet(out).select(
        file_name(), "start_byte", "end_byte", "value")
