"""Queries over manifests, uploads, logs and stored catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import humanize_size as readable
from tidemill.queries.registry import query
from tidemill.session import scratch_dir, table
from tidemill.sources import byte_ranges, catalog_json, files, logs

OFFSET = 1000     # inside most of the files
FAR_OFFSET = 1700  # behind the end of some


@query("""SELECT 'dataset-' || substr(sha256('acme/' || f), 1, 12) AS dataset_id,
  source || '.' || doc_id AS name, f AS file_name,
  'users/acme/datasets/dataset-' || substr(sha256('acme/' || f), 1, 12) || '/' || f AS file_path,
  '2024-01-01' AS created_at, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, lang AS format
FROM (SELECT *, source || '.' || doc_id || '.' || lang AS f FROM documents)""")
def register_datasets(spark: SparkSession, sf: str) -> DataFrame:
    uploaded = table(spark, sf, "documents").select(
        F.concat_ws(".", "source", "doc_id", "lang").alias("file_name"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.lit("2024-01-01").alias("created_at"))
    return files.register_datasets(uploaded, "acme").drop("samples")


@query("""SELECT doc_id AS upload_id, CAST(0 AS BIGINT) AS part_no, CAST(0 AS BIGINT) AS byte_offset,
  CAST(octet_length(encode(text)) AS BIGINT) AS file_bytes, md5(text) AS digest
FROM documents WHERE lang <> 'es'""")
def reassemble_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut in three; Spanish ones lost a chunk, and French ones sent one twice."""
    size = F.ceil(F.length("text") / 3).cast("int")
    numbers = F.when(F.col("lang") == "es", F.array(F.lit(2), F.lit(0))).when(
        F.col("lang") == "fr", F.array(F.lit(2), F.lit(0), F.lit(1), F.lit(0))).otherwise(
        F.array(F.lit(2), F.lit(1), F.lit(0)))
    chunks = table(spark, sf, "documents").withColumn("chunk_number", F.explode(numbers)).select(
        F.col("doc_id").alias("upload_id"), "chunk_number", F.lit(3).alias("total_chunks"),
        F.substring("text", F.col("chunk_number") * size + 1, size).alias("content"))
    return files.reassemble_chunks(chunks).select(
        "upload_id", "part_no", "byte_offset", "file_bytes", F.md5("content").alias("digest"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("data/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"),
                 F.lit(".txt")).alias("name"),
        "n_chars", "lang")


MANIFEST = """manifest AS (SELECT 'data/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt'
  AS name, n_chars, lang FROM documents)"""


@query(f"""WITH {MANIFEST} SELECT name, n_chars FROM manifest WHERE starts_with(name, 'data/src1')
ORDER BY name LIMIT 100""")
def list_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.list_files(manifest(spark, sf).select("name", "n_chars"), "data/src1")


@query(f"WITH {MANIFEST} SELECT name, n_chars FROM manifest WHERE NOT starts_with(name, 'data/src1/')")
def prefix_delete(spark: SparkSession, sf: str) -> DataFrame:
    return files.prefix_delete(manifest(spark, sf).select("name", "n_chars"), "data/src1")


@query("""SELECT doc_id, 'doc-' || doc_id AS name FROM documents WHERE lang <> 'de' AND n_chars <= 2000""")
def copy_manifest(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") > 2000).alias("is_dir"),
        F.when(F.col("lang") == "de", "tmp").otherwise(F.concat(F.lit("doc-"), "doc_id")).alias("name"))
    return files.copyable(listing).select("doc_id", "name")


@query("""WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * (doc_id + 1) * 512 AS b
  FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b)
  WHEN b < 1024 * 1024 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
  WHEN b < 1024 * 1024 * 1024 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
  ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS size FROM s""")
def humanize_size(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint") * (F.col("doc_id") + 1) * 512
    return table(spark, sf, "documents").select("doc_id", readable(size).alias("size"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("file"), F.col("event_id").alias("line_no"),
        F.concat_ws(" ", "event_id", "event_type", "props").alias("value"))


LOG_LINES = """lines AS (SELECT 'user-' || user_id AS file, event_id AS line_no,
    event_id || ' ' || event_type || ' ' || props AS value FROM events),
placed AS (SELECT *, CAST(sum(length(value) + 1) OVER (PARTITION BY file ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_byte FROM lines)"""


@query(f"""WITH {LOG_LINES}, begun AS (SELECT *, end_byte - length(value) - 1 AS start_byte FROM placed)
SELECT file, line_no, start_byte, end_byte,
  CASE WHEN start_byte < {OFFSET} THEN substr(value, {OFFSET} - start_byte + 1) ELSE value END AS value
FROM begun WHERE end_byte > {OFFSET}""")
def log_from_offset(spark: SparkSession, sf: str) -> DataFrame:
    return logs.log_from_offset(log_lines(spark, sf), OFFSET)


@query(f"""WITH {LOG_LINES} SELECT file, CAST(max(end_byte) AS BIGINT) AS file_bytes FROM placed
GROUP BY file HAVING max(end_byte) <= {FAR_OFFSET}""")
def log_out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    return logs.out_of_range(log_lines(spark, sf), FAR_OFFSET)


NUMBERED = f"""WITH {LOG_LINES}, numbered AS (SELECT file, value, end_byte,
  end_byte - length(value) - 1 AS line_start, row_number() OVER (ORDER BY file, line_no) - 1 AS row_id,
  row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS line_no FROM placed)"""


def file_name() -> Column:
    return F.substring_index("file", "/", -1).alias("file")


def written_log(spark: SparkSession, sf: str) -> str:
    """A folder with a log file per user."""
    folder = scratch_dir(spark, "logs")
    byte_ranges.write_lines(log_lines(spark, sf), folder)
    return folder


@query(NUMBERED + "SELECT file, row_id, line_no, line_start AS start_byte, end_byte, value FROM numbered")
def log_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Places and numbers of lines, from the files themselves, in ranges shorter than they are."""
    lines = byte_ranges.read_numbered(spark, written_log(spark, sf), range_bytes=FAR_OFFSET)
    return lines.select(file_name(), "row_id", "line_no", "start_byte", "end_byte", "value")


@query(NUMBERED + f"""SELECT file, line_no, greatest(line_start, {OFFSET}) AS start_byte, end_byte,
  CASE WHEN line_start < {OFFSET} THEN substr(value, {OFFSET} - line_start + 1) ELSE value END AS value
FROM numbered WHERE end_byte > {OFFSET}""")
def log_files_from_offset(spark: SparkSession, sf: str) -> DataFrame:
    lines = byte_ranges.read_numbered(spark, written_log(spark, sf), start_byte=OFFSET)
    return lines.select(file_name(), "line_no", "start_byte", "end_byte", "value")


@query(f"""WITH {LOG_LINES} SELECT file, CAST(max(end_byte) AS BIGINT) AS file_bytes FROM placed
GROUP BY file HAVING max(end_byte) <= {FAR_OFFSET}""")
def log_files_out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    return byte_ranges.files_out_of_range(spark, written_log(spark, sf), FAR_OFFSET).select(file_name(), "file_bytes")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created FROM orders""")
def catalog_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    path = scratch_dir(spark, "catalog")
    catalog_json.write_catalog(orders, path)
    stored = catalog_json.read_catalog(spark, path, orders.schema)
    return stored.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("""SELECT event_id,
  CASE WHEN event_type = 'purchase' THEN 'metrics' WHEN event_type IN ('view', 'signup') THEN 'raw'
    ELSE 'rejected' END AS status,
  CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN event_id + 0.5 END::DOUBLE AS "timestamp",
  CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN event_id END AS step,
  CASE WHEN event_type = 'purchase' THEN user_id END::DOUBLE AS gpu_utilization,
  CASE WHEN event_type = 'purchase' THEN length(props) END::DOUBLE AS memory_used,
  CASE WHEN event_type = 'purchase' THEN 64 END::DOUBLE AS memory_total,
  CASE WHEN event_type = 'view' THEN 'GPU[0], ' || props WHEN event_type = 'signup' THEN '1,2' END AS raw_line
FROM events""")
def hw_metrics_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a collector writes them, through a text file; one per event."""
    clock = F.concat("event_id", F.lit(".5"))
    kind = F.col("event_type")
    line = (
        F.when(kind == "purchase", F.concat_ws(
            ",", clock, "event_id", "user_id", F.length("props"), F.lit("64")))
        .when(kind == "view", F.concat_ws(",", clock, "event_id", F.lit("GPU[0]"), F.concat(F.lit(" "), "props")))
        .when(kind == "signup", F.concat_ws(",", clock, "event_id", F.lit("1"), F.lit("2")))
        .when(kind == "click", F.concat_ws(",", clock, F.lit("?"), F.lit("1"), F.lit("2"), F.lit("3")))
        .otherwise(F.concat(F.lit("lost "), "props")))
    path = scratch_dir(spark, "hw")
    header = ",".join(logs.HW_COLUMNS)
    events = table(spark, sf, "events").select(
        F.concat_ws("\t", "event_id", line).alias("value"))
    events.write.text(path)
    tagged = spark.read.text(path).select(
        F.substring_index("value", "\t", 1).cast("bigint").alias("event_id"),
        F.substring_index("value", "\t", -1).alias("value"))
    return logs.parse_hw_metrics(tagged.where(F.col("value") != header)).drop("value")


@query("""SELECT CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN 'parsed' ELSE 'rejected' END
  AS outcome, count(*) AS n FROM events GROUP BY 1""")
def hw_metrics_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file reader itself: parsed rows and rejected lines add up to the events."""
    kind = F.col("event_type")
    line = F.when(kind.isin("purchase", "view", "signup"), F.concat_ws(
        ",", "event_id", "event_id", "user_id", F.lit("1"), F.lit("2"))).otherwise(F.col("props"))
    path = scratch_dir(spark, "hw")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    parsed, rejected = logs.read_hw_metrics(spark, path)
    return parsed.select(F.lit("parsed").alias("outcome")).unionByName(
        rejected.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"))
