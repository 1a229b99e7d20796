"""Catalog tables as JSON lines with ISO timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
OPTIONS = {"timestampNTZFormat": ISO, "timestampFormat": ISO + "XXX"}


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**OPTIONS).option("ignoreNullFields", "false").json(path)


def read_catalog(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**OPTIONS).json(path)
