"""Queries over shard manifests: parts and order lines as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import manifest, rules
from tidemill.queries.registry import query
from tidemill.session import table

RANGES = """ranges(worker, lo, hi) AS (VALUES (0, 1, 4), (1, 4, 8), (2, 8, 12), (3, 12, 15),
  (4, 16, 19), (5, 19, 23), (6, 23, 27), (7, 27, 30))"""
NAME_RULES = (("^small", "mp"), ("(ring|bolt)$", "fsdp"), ("widget", "dp"))


def shards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("shard"))


@query(f"""WITH {RANGES} SELECT p_partkey, p_size AS shard, worker FROM part
JOIN ranges ON p_size BETWEEN lo AND hi""")
def range_join_shards(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.assign_shards(shards(spark, sf), manifest.range_table(spark))


@query(f"""WITH {RANGES} SELECT p_partkey, p_size AS shard, worker FROM part
JOIN ranges ON p_size BETWEEN lo AND hi
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber = worker AND l_partkey = p_partkey)""")
def copy_plan(spark: SparkSession, sf: str) -> DataFrame:
    present = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("worker"), F.col("l_partkey").alias("p_partkey"))
    return manifest.copy_plan(
        shards(spark, sf), manifest.range_table(spark), present,
        key=("worker", "p_partkey")).select("p_partkey", "shard", "worker")


@query(f"""WITH {RANGES} SELECT l_orderkey, l_linenumber AS worker,
  'model-' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 5, '0') || '-of-00030.safetensors' AS file_name,
  CAST(l_quantity AS INTEGER) AS shard FROM lineitem
JOIN ranges ON worker = l_linenumber WHERE CAST(l_quantity AS INTEGER) NOT BETWEEN lo AND hi""")
def cleanup_plan(spark: SparkSession, sf: str) -> DataFrame:
    present = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("worker"),
        F.format_string("model-%05d-of-00030.safetensors", F.col("l_quantity").cast("int")).alias("file_name"))
    return manifest.cleanup_plan(present, manifest.range_table(spark)).select(
        "l_orderkey", "worker", "file_name", "shard")


@query("""SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value, max(o_orderkey) AS shard
FROM orders GROUP BY o_custkey""")
def merge_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    written = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"),
        F.col("o_orderkey").alias("shard"))
    return manifest.merge_last_wins(written, "key", "value", "shard")


@query("""SELECT p_partkey, p_name, CASE WHEN p_size = 1 THEN '' WHEN regexp_matches(p_name, '^small') THEN 'mp'
  WHEN regexp_matches(p_name, '(ring|bolt)$') THEN 'fsdp' WHEN regexp_matches(p_name, 'widget') THEN 'dp' END AS spec
FROM part""")
def first_match_rule(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.first_match_rule(
        table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), NAME_RULES, "p_name",
        exempt=F.col("p_size") == 1).drop("p_size")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size <> 1 AND NOT regexp_matches(p_name, '^small')
  AND NOT regexp_matches(p_name, '(ring|bolt)$') AND NOT regexp_matches(p_name, 'widget')""")
def unmatched_names(spark: SparkSession, sf: str) -> DataFrame:
    ruled = manifest.first_match_rule(
        table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), NAME_RULES, "p_name",
        exempt=F.col("p_size") == 1)
    return manifest.unmatched(ruled).select("p_partkey", "p_name")


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'fsdp,mp' WHEN 'SMALL' THEN 'mp,fsdp'
  WHEN 'LARGE' THEN '' WHEN 'PROMO' THEN 'mp,fsdp' WHEN 'MEDIUM' THEN 'fsdp,mp' ELSE '' END AS spec FROM part""")
def parameter_specs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_type")
    leaf = (
        F.when(kind == "ECONOMY", "attention/wk/kernel").when(kind == "SMALL", "attention/wo/kernel")
        .when(kind == "LARGE", "ffn_norm/kernel").when(kind == "PROMO", "attention/wq/lora_b")
        .when(kind == "MEDIUM", "feed_forward/w3/kernel").otherwise("rotary/table"))
    named = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("/", F.lit("transformer/h"), "p_partkey", leaf).alias("path"))
    return manifest.first_match_rule(named, manifest.PARAMETER_RULES, "path").drop("path")


#: Paths are run/<customer>/step/<order>. The even rules also look at the last digit of the step.
MANY_RULES = [
    (f"^run/{n // 2}/step/[0-9]*{n % 10}$" if n % 2 == 0 else f"run/{n // 2}/", f"rule-{n}") for n in range(1, 5000)
    if n % 7] + [("/step/.*(5|10)$", "rest")]


@query("""WITH named AS (SELECT o_orderkey, 'run/' || o_custkey || '/step/' || o_orderkey AS path, o_custkey AS c,
  o_orderkey % 10 AS digit FROM orders)
SELECT o_orderkey, path, CASE WHEN c BETWEEN 1 AND 2499 AND (2 * c) % 7 <> 0 AND (2 * c) % 10 = digit
    THEN 'rule-' || (2 * c) WHEN c <= 2499 AND (2 * c + 1) % 7 <> 0 THEN 'rule-' || (2 * c + 1)
  WHEN digit = 5 OR o_orderkey % 100 = 10 THEN 'rest' END AS spec FROM named""")
def first_match_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """4,286 rules over the paths of all orders."""
    named = table(spark, sf, "orders").select("o_orderkey", F.concat(
        F.lit("run/"), "o_custkey", F.lit("/step/"), "o_orderkey").alias("path"))
    return rules.first_match_of_many(named, MANY_RULES, "path")
