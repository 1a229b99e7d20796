"""Example tables: JSON lines, named tables, prepared splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemill.sources.byte_ranges import RANGE_BYTES, read_numbered

TRIPLE = StructType([StructField(n, StringType()) for n in ("instruction", "input", "output")])
QUESTION = StructType([StructField(n, StringType()) for n in ("question", "answer")])
REPLY = StructType([StructField(n, StringType()) for n in ("input", "response")])
CHAT = StructType([StructField("messages", ArrayType(StructType([
    StructField("role", StringType()), StructField("content", StringType())])))])
PREPARED = StructType([
    StructField("example_id", StringType()),
    StructField("input_ids", ArrayType(IntegerType())),
    StructField("labels", ArrayType(IntegerType())),
    StructField("prompt_length", IntegerType()),
    StructField("response_length", IntegerType()),
    StructField("split", StringType()),
])

JSON_SUFFIXES = (".json", ".jsonl", ".json.gz", ".jsonl.gz")


def select_split(df: DataFrame, split: str | None) -> DataFrame:
    """Rows of one split; a table without a split column counts as that split."""
    if split is None or "split" not in df.columns:
        return df
    return df.where(F.col("split") == split)


def read_examples(
    spark: SparkSession, path: str, schema: StructType, split: str | None = "train"
) -> DataFrame:
    """JSON lines with a given schema; the input is not read an extra time to infer one."""
    return select_split(spark.read.schema(schema).json(path), split)


ROW_KEYS = ("row_id", "file", "line_no")


def read_keyed_examples(
    spark: SparkSession, path: str, schema: StructType, split: str | None = "train",
    pattern: str = "*", range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """JSON lines with their identity: file, number of the line in it, and ``row_id``, which numbers
    the lines of all files in the order of their paths.

    The keys are the same however the files are cut into tasks, so a limit or a split by ``row_id`` takes the
    same rows every time, equal rows included. Blank lines have numbers but give no rows. Every use of the result
    reads the files anew; ``stage`` it where several passes follow, as for a limit.
    """
    clash = set(ROW_KEYS) & set(schema.names)
    if clash:
        raise ValueError(f"the examples have columns of their own named {', '.join(sorted(clash))}")
    lines = read_numbered(spark, path, pattern, range_bytes=range_bytes).where("trim(BOTH ' \t\r' FROM value) <> ''")
    rows = lines.select(*ROW_KEYS, F.from_json("value", schema).alias("__row")).select(*ROW_KEYS, "__row.*")
    return select_split(rows, split)


def read_table_examples(
    spark: SparkSession, name: str, split: str | None = "train"
) -> DataFrame:
    """A Parquet folder or file when the name looks like a path, else a catalog table."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return select_split(df, split)


def load_source(
    spark: SparkSession, uri: str, schema: StructType | None = None, split: str | None = "train"
) -> DataFrame:
    if uri.lower().endswith(JSON_SUFFIXES):
        return read_examples(spark, uri, schema or TRIPLE, split)
    return read_table_examples(spark, uri, split)


def write_prepared(df: DataFrame, path: str) -> None:
    """One folder per split, so that a reader of one split opens no file of another."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_prepared(
    spark: SparkSession, path: str, split: str | None = None, schema: StructType = PREPARED
) -> DataFrame:
    return select_split(spark.read.schema(schema).parquet(path), split)


def synthetic_batches(
    ids: DataFrame, batch_size: int, length: int, id_col: str = "id"
) -> DataFrame:
    """Constant rows of model input, one per id: zero ids and labels, a mask of ones."""
    zeros = F.array_repeat(F.lit(0), length)
    return ids.select(
        F.floor(F.col(id_col) / batch_size).alias("batch_id"),
        (F.col(id_col) % batch_size).cast("int").alias("row_in_batch"),
        zeros.alias("input_ids"),
        zeros.alias("labels"),
        F.array_repeat(F.lit(1), length).alias("attention_mask"),
        F.sequence(F.lit(0), F.lit(length - 1)).alias("position_ids"),
    )
