"""Small files in the folder that all executors share, through the file systems that Spark itself knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, where, _ = _file_system(spark, folder)
    if not system.exists(where):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    system, where, jvm = _file_system(spark, path)
    stream = system.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file whole: under another name first, then renamed. Fails if the file is there."""
    system, where, jvm = _file_system(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    stream = system.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(where) or not system.rename(beside, where):
        system.delete(beside, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    system, where, _ = _file_system(spark, path)
    system.delete(where, True)
