"""Queries over job tables: orders and events as jobs, at a fixed point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import catalog, jobs
from tidemill.queries.registry import query
from tidemill.session import table

STAMP = "yyyy-MM-dd HH:mm:ss"
STATUS = {"F": "cleanup", "O": "running", "P": "pending"}
TUNE_STATES = {"click": "running", "view": "initializing", "purchase": "completed", "error": "error",
               "signup": "pending"}
ACCELERATOR = {"click": "ready", "view": "running", "purchase": "failed", "error": "error",
               "signup": "provisioning"}


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""WITH j AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cleanup' WHEN 'O' THEN 'running'
    ELSE 'pending' END AS status, o_orderdate + INTERVAL 1 DAY AS u, o_orderdate + INTERVAL 2 DAY AS c FROM orders),
a AS (SELECT o_orderkey, status, CASE WHEN status = 'cleanup' AND c <= TIMESTAMP '1998-06-03' THEN 'cleanup'
    WHEN u <= TIMESTAMP '1998-06-03' THEN 'update' END AS action FROM j)
SELECT * FROM a WHERE action IS NOT NULL""")
def due_jobs(spark: SparkSession, sf: str) -> DataFrame:
    waiting = table(spark, sf, "orders").select(
        "o_orderkey", catalog.lookup_default(F.col("o_orderstatus"), STATUS).alias("status"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1))).alias("next_update_at"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(2))).alias("cleanup_at"))
    return jobs.due_jobs(waiting, at("1998-06-03 00:00:00")).select("o_orderkey", "status", "action")


@query("""SELECT event_id, strftime(ts + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS next_update_at,
  strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS cleanup_at FROM events""")
def job_times(spark: SparkSession, sf: str) -> DataFrame:
    started = jobs.schedule_times(table(spark, sf, "events"), F.col("ts"))
    return started.select("event_id", *[
        F.date_format(c, STAMP).alias(c) for c in ("next_update_at", "cleanup_at")])


@query("""SELECT event_id, CASE
    WHEN event_type IN ('click', 'view') AND TIMESTAMP '2024-01-15 12:00:00' > ts + INTERVAL 3 HOUR THEN 'cleanup'
    WHEN event_type = 'purchase' THEN 'cleanup' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS next_status,
  CASE WHEN event_type = 'error' THEN 'Fine-tuning job failed' END AS next_error FROM events""")
def finetune_transition(spark: SparkSession, sf: str) -> DataFrame:
    running = table(spark, sf, "events").select(
        "event_id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"),
        catalog.lookup_default(F.col("event_type"), TUNE_STATES).alias("tune_status"),
        F.col("ts").alias("created_at"))
    return jobs.finetune_transition(running, at("2024-01-15 12:00:00")).select(
        "event_id", "next_status", "next_error")


@query("""WITH a AS (SELECT event_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS h FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN
      CASE WHEN h = 0 OR ts + to_hours(h) < TIMESTAMP '2024-01-15 12:00:00' THEN 'cleanup' ELSE 'running' END
    WHEN event_type IN ('purchase', 'error') THEN 'failed' ELSE 'cleanup' END AS next_status,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'Accelerator provisioning failed' END AS next_error FROM a""")
def accelerator_transition(spark: SparkSession, sf: str) -> DataFrame:
    machines = table(spark, sf, "events").select(
        "event_id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"),
        catalog.lookup_default(F.col("event_type"), ACCELERATOR).alias("accelerator_status"),
        F.get_json_object("props", "$.k").cast("int").alias("auto_shutdown_hrs"),
        F.col("ts").alias("created_at"))
    return jobs.accelerator_transition(machines, at("2024-01-15 12:00:00")).select(
        "event_id", "next_status", "next_error")


@query("""WITH e AS (SELECT o_custkey, count(*) AS n, arg_max(o_orderpriority, o_orderkey) AS e
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS job_id, coalesce(n, 0) AS attempts, CASE WHEN n >= 3 THEN 'failed' ELSE 'pending' END AS status,
  e AS error FROM customer LEFT JOIN e ON o_custkey = c_custkey""")
def fail_jobs(spark: SparkSession, sf: str) -> DataFrame:
    waiting = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("error"))
    errors = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("error"),
        F.col("o_orderkey").alias("seq"))
    return jobs.fail_jobs(waiting, errors)


@query("""WITH u AS (SELECT user_id AS tune_id, event_id AS seq, value AS progress, CASE event_type
    WHEN 'click' THEN 'running' WHEN 'view' THEN 'initializing' WHEN 'purchase' THEN 'completed'
    WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events)
SELECT tune_id, arg_max(status, seq) AS status, arg_max(progress, seq) AS progress,
  max(progress) AS max_progress, bool_or(status = 'completed') AS done, bool_or(status = 'failed') AS failed,
  count(*) AS n_updates FROM u GROUP BY tune_id""")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    states = {**TUNE_STATES, "error": "failed"}
    updates = table(spark, sf, "events").select(
        F.col("user_id").alias("tune_id"), F.col("event_id").alias("seq"), F.col("value").alias("progress"),
        catalog.lookup_default(F.col("event_type"), states).alias("status"))
    return jobs.latest_status(updates)
