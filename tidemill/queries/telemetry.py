"""Queries over training logs: events as steps, users as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import telemetry
from tidemill.queries.registry import query
from tidemill.session import table


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("run"), F.col("event_id").alias("step"),
        F.col("value").alias("loss"), "event_type", "ts", "props")


@query("""SELECT event_id, event_type <> 'error' AS matched,
  CASE WHEN event_type <> 'error' THEN event_id END AS step,
  CASE WHEN event_type <> 'error' THEN value END AS train_loss,
  CASE WHEN event_type <> 'error' THEN value / 2 END AS val_loss FROM events""")
def parse_step_log(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("event_type") != "error", F.format_string(
        "Step %d | Train Loss: %.4f | Val Loss: %.4f | ", "step", "loss", F.col("loss") / 2)
    ).otherwise(F.concat(F.lit("Traceback: "), "props"))
    lines = steps(spark, sf).select("event_id", line.alias("value"))
    return telemetry.parse_step_log(lines).drop("value")


@query("""SELECT event_id,
  CASE event_type WHEN 'click' THEN 'epoch' WHEN 'view' THEN 'training' WHEN 'signup' THEN 'training'
    ELSE 'unmatched' END AS layout,
  CASE WHEN event_type IN ('click', 'view') THEN user_id END AS epoch,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN event_id END AS step,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN value END AS train_loss,
  CASE WHEN event_type = 'click' THEN 0.25 END::DOUBLE AS accuracy,
  CASE WHEN event_type = 'click' THEN 0.5 END::DOUBLE AS step_time,
  CASE WHEN event_type = 'click' THEN 2.0 END::DOUBLE AS steps_per_sec FROM events""")
def parse_epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.format_string(
            "Epoch %d, Step %d, Train Loss: %.4f, Accuracy: 0.2500, Step Time: 0.5000s, Steps/sec: 2.00",
            "run", "step", "loss"))
        .when(kind == "view", F.format_string("Training | Epoch=%d | Step=%d | Loss=%.5f", "run", "step", "loss"))
        .when(kind == "signup", F.format_string("Training | Step=%d | Loss=%.5f", "step", "loss"))
        .otherwise(F.concat(F.lit("Epoch ?, "), "props")))
    lines = steps(spark, sf).select("event_id", line.alias("value"))
    return telemetry.parse_epoch_log(lines).drop("value")


@query("""SELECT event_id,
  CASE event_type WHEN 'error' THEN 'stderr' WHEN 'view' THEN 'stdout' WHEN 'click' THEN 'service'
    WHEN 'signup' THEN 'service' ELSE 'unmatched' END AS source,
  CASE WHEN event_type IN ('click', 'signup') THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000' END AS asctime,
  CASE WHEN event_type IN ('click', 'signup') THEN 'training' END AS logger,
  CASE event_type WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'WARNING' END AS level,
  CASE event_type WHEN 'signup' THEN 'user ' || user_id || ' - joined' ELSE props END AS message FROM events""")
def parse_service_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    clock = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000"))
    line = (
        F.when(kind == "error", F.concat(F.lit("STDERR: "), "props"))
        .when(kind == "view", F.concat(F.lit("STDOUT: "), "props"))
        .when(kind == "click", F.concat(clock, F.lit(" - training - INFO - "), "props"))
        .when(kind == "signup", F.concat(clock, F.lit(" - training - WARNING - user "), "run", F.lit(" - joined")))
        .otherwise(F.col("props")))
    lines = steps(spark, sf).select("event_id", line.alias("value"))
    return telemetry.parse_service_log(lines).drop("value")


@query("""SELECT user_id AS run, event_id AS step, value AS loss,
  coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0.0) AS prev_loss FROM events""")
def lagged_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.lagged_metrics(
        steps(spark, sf).select("run", "step", "loss"), "run", "step", ["loss"])


@query("""SELECT user_id AS run, event_id AS step, value AS loss,
  coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS val_loss
FROM events""")
def carry_forward_val(spark: SparkSession, sf: str) -> DataFrame:
    reported = steps(spark, sf).select(
        "run", "step", "loss",
        F.when(F.col("event_type") == "purchase", F.col("loss")).alias("val_loss"))
    return telemetry.carry_forward_value(reported, "run", "step", "val_loss")


@query("""SELECT o_orderkey AS step, o_orderkey = 1 OR (o_orderkey + 1) % 10 = 0 AS do_log,
  (o_orderkey + 1) % 250 = 0 AS do_eval,
  (o_orderkey + 1) % 400 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders) AS do_save FROM orders""")
def step_schedule(spark: SparkSession, sf: str) -> DataFrame:
    numbered = table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"))
    return telemetry.step_schedule(numbered, 10, 250, 400)


@query("""SELECT user_id AS run, count(*) AS n_steps, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)
  AS total_seconds, round(count(*) / CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) AS steps_per_sec
FROM events GROUP BY user_id""")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    timed = steps(spark, sf).withColumn("seconds", F.col("loss").cast("decimal(18,2)"))
    return telemetry.throughput(timed, "run", "seconds").select(
        "run", "n_steps", F.col("total_seconds").cast("double").alias("total_seconds"),
        F.round("steps_per_sec", 6).alias("steps_per_sec"))


@query("""SELECT event_id, round(1.0 / nullif(value, 0), 6) AS steps_per_sec FROM events""")
def step_rate(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select(
        "event_id", F.round(telemetry.step_rate(F.col("loss")), 6).alias("steps_per_sec"))


@query("""WITH r AS (SELECT CASE WHEN p_type = 'PROMO' THEN 'tokenizer-' || p_partkey || '.json'
    ELSE 'model-' || p_partkey || '.safetensors' END AS name, p_size * 100000000::BIGINT AS b,
    CAST(p_retailprice AS DECIMAL(18,2)) AS s FROM part)
SELECT count(*) AS n_files, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(s) AS DOUBLE) AS total_seconds,
  round(sum(b)::DOUBLE / 1073741824 / CAST(sum(s) AS DOUBLE), 6) AS gb_per_sec
FROM r WHERE starts_with(name, 'model-') AND ends_with(name, '.safetensors')""")
def read_speed(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("tokenizer-"), "p_partkey", F.lit(".json"))
                  ).otherwise(F.concat(F.lit("model-"), "p_partkey", F.lit(".safetensors")))
    reads = table(spark, sf, "part").select(
        name.alias("name"), (F.col("p_size") * F.lit(100_000_000).cast("bigint")).alias("size_bytes"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("seconds"))
    return telemetry.read_speed(reads).select(
        "n_files", "total_bytes", F.col("total_seconds").cast("double").alias("total_seconds"),
        F.round("gb_per_sec", 6).alias("gb_per_sec"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3""")
def retain_latest(spark: SparkSession, sf: str) -> DataFrame:
    saved = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return telemetry.retain_latest(saved, "o_custkey", "o_orderkey", keep=3)


@query("SELECT o_custkey, max(o_orderkey) AS latest_step FROM orders GROUP BY o_custkey")
def latest_step(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.latest_step(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
