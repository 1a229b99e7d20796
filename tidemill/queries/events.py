"""Queries over usage events and billing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import billing, events
from tidemill.queries.registry import query
from tidemill.session import table

STAMP = "yyyy-MM-dd HH:mm:ss"
MICRO_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

PRICES = [("click", 10.0, 60), ("view", 2.5, 60), ("signup", 0.75, 120), ("purchase", 32.7726, 60),
          ("error", 1.0, 0)]
THRESHOLDS, LIMIT = [0.5, 1.0, 2.5], 5.0


def stamp(column: str, pattern: str = STAMP):
    """Instants as text of the session's zone, which is how they were read."""
    return F.date_format(column, pattern).alias(column)


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def event_props(spark: SparkSession, sf: str) -> DataFrame:
    return events.parse_events(table(spark, sf, "events"), "k bigint").select(
        "event_id", "user_id", "event_type", F.col("props.k").alias("k"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
  count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = events.tumbling_counts(table(spark, sf, "events"), "1 day")
    return counts.select(stamp("window_start"), stamp("window_end"), "event_type", "n")


def cents(column: str) -> Column:
    """The tables' values are whole cents; decimals add up the same way in any order."""
    return F.col(column).cast("decimal(38,2)")


@query("""WITH s AS (SELECT event_type, value, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot FROM events),
w AS (SELECT event_type, value, slot - r.range AS first_slot FROM s, range(4) r)
SELECT strftime(make_timestamp(first_slot * 21600 * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
  count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_value
FROM w GROUP BY first_slot, event_type""")
def sliding_avg(spark: SparkSession, sf: str) -> DataFrame:
    averages = events.sliding_avg(
        table(spark, sf, "events").withColumn("value", cents("value")), slides=4, slide_seconds=6 * 3600)
    return averages.select(stamp("window_start"), "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event, count(*) AS n_events,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM s GROUP BY user_id, no""")
def session_events(spark: SparkSession, sf: str) -> DataFrame:
    sessions = events.session_events(
        table(spark, sf, "events").withColumn("value", cents("value")), 6 * 3600)
    return sessions.select(
        "user_id", stamp("session_start", MICRO_STAMP), stamp("last_event", MICRO_STAMP), "n_events",
        F.col("total_value").cast("double").alias("total_value"))


@query("""SELECT event_type, reason, CAST(grouping(event_type) * 2 + grouping(reason) AS INTEGER) AS level,
  count(*) AS n FROM (SELECT event_type, json_extract_string(props, '$.k') AS reason FROM events
  WHERE event_type IN ('error', 'signup')) GROUP BY ROLLUP (event_type, reason)""")
def failure_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return events.failure_breakdown(
        table(spark, sf, "events"), F.col("event_type").isin("error", "signup"),
        F.get_json_object("props", "$.k"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("gpu_type"),
        F.floor("value").cast("bigint").alias("duration_seconds"))


def costs(spark: SparkSession, sf: str, minimum: bool = False) -> DataFrame:
    return billing.job_cost(usage(spark, sf), billing.pricing_table(spark, PRICES), minimum)


def costs_sql(billed: str) -> str:
    """Millionths of a dollar in whole numbers, rounded half up."""
    return f"""prices(gpu_type, rate, units, least_s) AS (VALUES ('click', 10.0, 100000, 60), ('view', 2.5, 25000, 60),
    ('signup', 0.75, 7500, 120), ('purchase', 32.7726, 327726, 60), ('error', 1.0, 10000, 0)),
usage AS (SELECT event_id, user_id, ts, event_type AS gpu_type, CAST(floor(value) AS BIGINT) AS s FROM events),
billed AS (SELECT *, {billed} AS billed_seconds FROM usage JOIN prices USING (gpu_type)),
costs AS (SELECT *, (2 * billed_seconds * units * 100 + 3600) // 7200 AS micros FROM billed)"""


PLAIN, MINIMUM = costs_sql("s"), costs_sql("greatest(s, least_s)")


@query(f"""WITH {PLAIN} SELECT event_id, CAST(billed_seconds AS BIGINT) AS billed_seconds,
  micros / 1000000 AS cost FROM costs""")
def job_cost(spark: SparkSession, sf: str) -> DataFrame:
    return costs(spark, sf).select("event_id", "billed_seconds", F.col("cost").cast("double").alias("cost"))


@query(f"""WITH {MINIMUM} SELECT event_id, CAST(billed_seconds AS BIGINT) AS billed_seconds,
  micros / 1000000 AS cost FROM costs""")
def job_cost_min(spark: SparkSession, sf: str) -> DataFrame:
    return costs(spark, sf, minimum=True).select(
        "event_id", "billed_seconds", F.col("cost").cast("double").alias("cost"))


@query(f"""WITH {MINIMUM} SELECT user_id, gpu_type, CAST(sum(billed_seconds) AS BIGINT) AS seconds,
  CAST(max(rate) AS DOUBLE) AS cost_per_hour, sum(micros)::DOUBLE / 1000000 AS total_cost
FROM costs GROUP BY user_id, gpu_type""")
def usage_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return billing.usage_breakdown(costs(spark, sf, minimum=True)).withColumn(
        "total_cost", F.col("total_cost").cast("double"))


@query(f"""WITH {MINIMUM} SELECT user_id, CAST(count(DISTINCT gpu_type) AS INTEGER) AS n_types,
  CAST(sum(CASE WHEN gpu_type = 'click' THEN billed_seconds END) AS BIGINT) AS click_seconds
FROM costs GROUP BY user_id""")
def usage_breakdown_map(spark: SparkSession, sf: str) -> DataFrame:
    breakdown = billing.usage_breakdown(costs(spark, sf, minimum=True))
    return billing.breakdown_map(breakdown).select(
        "user_id", F.size("usage_breakdown").alias("n_types"),
        F.try_element_at("usage_breakdown", F.lit("click")).getField("seconds").alias("click_seconds"))


@query(f"""WITH {MINIMUM} SELECT month, gpu_type, CAST(grouping(month) * 2 + grouping(gpu_type) AS INTEGER) AS level,
  count(*) AS n_jobs, CAST(sum(billed_seconds) AS BIGINT) AS seconds, sum(micros)::DOUBLE / 1000000 AS total_cost
FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM costs) GROUP BY ROLLUP (month, gpu_type)""")
def billing_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return billing.billing_rollup(costs(spark, sf, minimum=True)).withColumn(
        "total_cost", F.col("total_cost").cast("double"))


@query(f"""WITH {MINIMUM}, run AS (SELECT *, strftime(ts, '%Y-%m') AS month, sum(micros) OVER (
    PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM costs),
marks(threshold, stop) AS (VALUES (500000, false), (1000000, false), (2500000, false), (5000000, true))
SELECT user_id, month, threshold::DOUBLE / 1000000 AS threshold, event_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, upto::DOUBLE / 1000000 AS running_cost, stop
FROM run JOIN marks ON upto >= threshold AND upto - micros < threshold""")
def cost_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = billing.cost_alerts(costs(spark, sf, minimum=True), THRESHOLDS, LIMIT)
    return alerts.select(
        "user_id", "month", F.col("threshold").cast("double").alias("threshold"), "event_id",
        stamp("ts", MICRO_STAMP), F.col("running_cost").cast("double").alias("running_cost"), "stop")
