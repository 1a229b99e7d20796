"""Queries over catalog tables: customers, orders, documents and labels as entries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import hash_id as short_hash
from tidemill.operators import catalog, select
from tidemill.queries.registry import query
from tidemill.session import settings_table, table

DAY = "yyyy-MM-dd"


@query("""SELECT o_orderkey AS job, o_orderstatus AS status, o_orderpriority AS priority,
  strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders""")
def catalog_list_view(spark: SparkSession, sf: str) -> DataFrame:
    jobs = catalog.catalog_list(table(spark, sf, "orders"))
    return catalog.list_view(
        jobs, {"job": "o_orderkey", "status": "o_orderstatus", "priority": "o_orderpriority"},
        "o_orderdate")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77
ORDER BY o_orderkey LIMIT 1""")
def catalog_get(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return catalog.catalog_get(orders, "o_custkey", 77, "o_orderkey")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def catalog_append(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return catalog.catalog_append(base, rows)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def catalog_remove(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return catalog.catalog_remove(orders, gone, "o_custkey")


UPSERTED = """
newest AS (SELECT o_custkey AS id, o_orderstatus AS status, o_orderkey AS seq FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("seq"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"),
        F.lit(-1).cast("bigint").alias("seq"))


@query(f"""WITH {UPSERTED} SELECT id, status, seq FROM newest
UNION ALL SELECT c_custkey, c_mktsegment, -1 FROM customer WHERE c_custkey NOT IN (SELECT id FROM newest)""")
def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_upsert(entries(spark, sf), changes(spark, sf), "id", "seq")


@query("""SELECT user_id AS key, value FROM (SELECT user_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE value IS NOT NULL""")
def kv_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.nullif(F.col("event_type"), F.lit("error")).alias("value"),
        F.col("event_id").alias("seq"))
    return catalog.kv_latest(log)


@query(f"""WITH {UPSERTED} SELECT c_custkey AS id, coalesce(n.status, c_mktsegment) AS status,
  coalesce(n.seq, -1) AS seq FROM customer LEFT JOIN newest n ON n.id = c_custkey""")
def status_sync(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.status_sync(entries(spark, sf), changes(spark, sf), "id", updated="seq")


def tied(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of which many of one id have the same sequence number, or none."""
    return changes(spark, sf).withColumn("seq", F.when(F.col("seq") % 5 > 0, F.floor(F.col("seq") / 4096))).withColumn(
        "status", F.concat("status", F.col("id") % 3))


TIED = """tied AS (SELECT o_custkey AS id, o_orderstatus || o_custkey % 3 AS status,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey // 4096 END AS seq FROM orders)"""


@query(f"""WITH {TIED} SELECT * FROM tied QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY seq DESC NULLS LAST, status DESC) = 1""")
def catalog_ties(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest(tied(spark, sf), ["id"], "seq")


@query(f"""WITH {TIED}, partly AS (SELECT CASE WHEN id % 7 > 0 THEN id END AS id, status, seq FROM tied),
newest AS (SELECT * FROM partly QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY seq DESC NULLS LAST, status DESC) = 1)
SELECT * FROM newest UNION ALL SELECT * FROM (
  SELECT CASE WHEN c_custkey % 9 > 0 THEN c_custkey END AS id, c_mktsegment AS status, -1 AS seq FROM customer)
WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM newest WHERE id IS NOT NULL)""")
def catalog_null_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The change without an id replaces the entries without one."""
    some = tied(spark, sf).withColumn("id", F.when(F.col("id") % 7 > 0, F.col("id")))
    old = entries(spark, sf).withColumn("id", F.when(F.col("id") % 9 > 0, F.col("id")))
    return catalog.catalog_upsert(old, some, "id", "seq")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def valid_refs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return catalog.valid_refs(docs, table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_refs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return catalog.orphan_refs(docs, table(spark, sf, "labels"), "doc_id")


@query("""SELECT d.doc_id AS dataset_id, CASE WHEN lang = 'en' THEN NULL ELSE 'hub/' || source END AS dataset_path,
  coalesce(CASE WHEN lang = 'en' THEN NULL ELSE 'hub/' || source END, 'users/acme/q' || quality || '.jsonl')
    AS resolved_path FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def resolve_dataset_path(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "documents").select(
        F.col("doc_id").alias("dataset_id"),
        F.when(F.col("lang") != "en", F.concat(F.lit("hub/"), "source")).alias("dataset_path"))
    datasets = table(spark, sf, "labels").select(
        F.col("doc_id").alias("dataset_id"), F.concat(F.lit("q"), "quality", F.lit(".jsonl")).alias("file_name"))
    return catalog.resolve_dataset_path(requests, datasets, "users/acme/")


@query("""SELECT o_orderkey AS tune_id, o_orderstatus AS status, c_name AS model_name, n_name AS dataset_name,
  r_name AS accelerator_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def job_view(spark: SparkSession, sf: str) -> DataFrame:
    tunes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("tune_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("model_id"))
    models = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("model_id"), F.col("c_name").alias("model_name"),
        F.col("c_nationkey").alias("dataset_id"))
    datasets = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("dataset_name"),
        F.col("n_regionkey").alias("accelerator_id"))
    accelerators = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("accelerator_id"), F.col("r_name").alias("accelerator_name"))
    return catalog.job_view(tunes, models, datasets, accelerators).select(
        "tune_id", "status", "model_name", "dataset_name", "accelerator_name")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'tier-a' WHEN '2-HIGH' THEN 'tier-b'
  ELSE o_orderpriority END AS repository,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'tier-a' WHEN '2-HIGH' THEN 'tier-b' ELSE 'stock' END AS runtime
FROM orders""")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    names = {"1-URGENT": "tier-a", "2-HIGH": "tier-b"}
    key = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", catalog.lookup_default(key, names).alias("repository"),
        catalog.lookup_default(key, names, "stock").alias("runtime"))


@query("""SELECT p_partkey, lower(p_type) AS family, p_brand AS size, v.cores
FROM part LEFT JOIN (VALUES ('economy', 'Brand#2', 8), ('economy', 'Brand#4', 16), ('small', 'Brand#5', 32),
  ('promo', 'Brand#17', 64)) v(family, size, cores) ON lower(p_type) = v.family AND p_brand = v.size""")
def split_lookup(spark: SparkSession, sf: str) -> DataFrame:
    configs = settings_table(
        spark, [("economy", "Brand#2", 8), ("economy", "Brand#4", 16), ("small", "Brand#5", 32),
                ("promo", "Brand#17", 64)],
        {"family": pa.string(), "size": pa.string(), "cores": pa.int32()})
    models = table(spark, sf, "part").select("p_partkey", F.concat_ws("-", "p_type", "p_brand").alias("model"))
    return catalog.split_lookup(models, "model", configs).select("p_partkey", "family", "size", "cores")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'terminated'
  ELSE 'unknown' END AS status FROM orders""")
def map_status(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.map_status(
        orders, "o_orderstatus", {"O": "running", "F": "terminated"}).select("o_orderkey", "status")


@query("""WITH r AS (SELECT doc_id AS location, lang, unnest(string_split(text, chr(10))) AS region FROM documents)
SELECT location, region, region || CASE WHEN lang <> 'de' THEN '-b' ELSE '-a' END AS zone FROM r""")
def explode_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested lists: a location with its lines as regions."""
    locations = table(spark, sf, "documents").select(
        F.col("doc_id").alias("location"), "lang", F.split("text", "\n").alias("regions"))
    zone = catalog.default_zone(F.col("region"), F.col("lang") != "de")
    return catalog.explode_regions(locations).select("location", "region", zone.alias("zone"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 32 END::INTEGER AS batch_size,
  coalesce(nullif(c_mktsegment, 'BUILDING'), 'adam') AS optimizer, 100::INTEGER AS num_steps FROM customer""")
def merge_defaults(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("batch_size"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("optimizer"))
    return catalog.merge_defaults(requests, {"batch_size": 32, "optimizer": "adam", "num_steps": 100})


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '0' ELSE json_extract_string(props, '$.k') END AS k,
  'test' AS mode, CAST(2 AS INTEGER) AS n_keys FROM events""")
def merge_maps(spark: SparkSession, sf: str) -> DataFrame:
    defaults = F.create_map(F.lit("k"), F.lit("0"), F.lit("mode"), F.lit("test"))
    given = F.when(F.col("event_type") != "error", F.from_json("props", "map<string,string>"))
    merged = table(spark, sf, "events").select(
        "event_id", catalog.merge_maps(defaults, given).alias("m"))
    return merged.select("event_id", F.col("m.k").alias("k"), F.col("m.mode").alias("mode"),
                         F.size("m").alias("n_keys"))


@query("""SELECT c_custkey AS id, c_name AS "model.name", c_mktsegment AS "model.data.segment",
  c_nationkey AS "model.data.nation" FROM customer""")
def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("name"),
                 F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("data"),
                 ).alias("model"))
    return catalog.flatten_struct(nested)


@query("""SELECT lang, doc_id >> 12 AS block_no, CAST(list(doc_id ORDER BY doc_id) AS VARCHAR) AS ids
FROM documents GROUP BY 1, 2""")
def index_by(spark: SparkSession, sf: str) -> DataFrame:
    indexed = catalog.index_by(table(spark, sf, "documents"), "lang", "doc_id")
    return indexed.withColumn("ids", F.col("ids").cast("string"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'),
gone_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_orders)""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return catalog.cascade_delete(
        [(orders, "o_custkey", "o_orderkey"), (lines, "l_orderkey", None)], gone)[-1]


@query("""SELECT doc_id, quality FROM labels UNION ALL
SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"))
    return catalog.insert_if_absent(
        table(spark, sf, "labels").select("doc_id", "quality"), rows, "doc_id")


@query("SELECT c_custkey, substr(sha256(c_name || '@acme.test'), 1, 12) AS user_id FROM customer")
def hash_id(spark: SparkSession, sf: str) -> DataFrame:
    email = F.concat(F.col("c_name"), F.lit("@acme.test"))
    return table(spark, sf, "customer").select("c_custkey", short_hash(email).alias("user_id"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'stopping' ELSE o_orderstatus END AS status,
  CASE WHEN c_custkey IS NOT NULL THEN '1999-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'""")
def stop_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", DAY).alias("updated_at"))
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"))
    return catalog.stop_jobs(jobs, keys, "user_id", F.lit("1999-01-01")).drop("user_id")


# --- validation and name filters ---------------------------------------------------------

@query("""WITH r AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'llama3_1-8b'
    WHEN 'MACHINERY' THEN 'llama3_2-1b' ELSE c_mktsegment END AS model,
    CASE WHEN c_acctbal > 0 THEN c_nationkey END AS dataset_id FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN model NOT IN ('llama3_1-8b', 'llama3_2-1b') THEN 'unsupported_model' END,
    CASE WHEN dataset_id IS NULL THEN 'missing_dataset' END) AS reasons,
  model IN ('llama3_1-8b', 'llama3_2-1b') AND dataset_id IS NOT NULL AS valid FROM r""")
def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    requests = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(segment == "BUILDING", "llama3_1-8b").when(segment == "MACHINERY", "llama3_2-1b")
        .otherwise(segment).alias("model"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("dataset_id"),
        F.lit(None).cast("string").alias("dataset_path"))
    return select.validate_requests(requests).select(
        "c_custkey", F.array_join("reasons", ",").alias("reasons"), "valid")


@query("""WITH a AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'v3' WHEN 'SMALL' THEN 'v5e'
    WHEN 'LARGE' THEN 'v5p' ELSE p_type END AS t, p_size * 4 AS cores FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN t NOT IN ('v3', 'v5e', 'v5p') THEN 'accelerator_type' END,
    CASE WHEN NOT (cores % 8 = 0 AND cores BETWEEN 8 AND 1024) THEN 'core_count' END) AS reasons,
  t IN ('v3', 'v5e', 'v5p') AND cores % 8 = 0 AND cores BETWEEN 8 AND 1024 AS valid FROM a""")
def validate_numeric_rule(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"ECONOMY": "v3", "SMALL": "v5e", "LARGE": "v5p"}
    machines = table(spark, sf, "part").select(
        "p_partkey", catalog.lookup_default(F.col("p_type"), kinds).alias("accelerator_type"),
        (F.col("p_size") * 4).alias("cores"))
    return select.validate_accelerator(machines).select(
        "p_partkey", F.array_join("reasons", ",").alias("reasons"), "valid")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'l') AND contains(p_name, 'i')
  AND NOT contains(p_name, 'ring')""")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return select.keyword_filter(
        table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["l", "i"], ["ring"])


@query("""SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, 'bolt') AS selected FROM part""")
def name_partition(spark: SparkSession, sf: str) -> DataFrame:
    return select.name_partition(table(spark, sf, "part"), "p_name", ["ring", "bolt"]).select(
        "p_partkey", "selected")
