"""Starting streams, and running them over what is there so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None, ts: str = "ts",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Parquet files of a folder as a stream, with a timestamp that takes a watermark."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_files(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process all available input, append the results to Parquet files, and stop.

    Results go to files rather than to memory, and the checkpoint makes a second run
    continue where the first one stopped.
    """
    df.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
