"""From a source of examples to padded batches, by the settings of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.config import PrepConfig
from tidemill.functions.tokens import Tokenizer
from tidemill.operators.batching import assign_batches, collate, pad_batches
from tidemill.operators.prepare import prepare
from tidemill.operators.split import shuffle_ranked
from tidemill.plans.order import by_id, dense_rank
from tidemill.session import stage
from tidemill.sources.examples import JSON_SUFFIXES, TRIPLE, read_keyed_examples, read_table_examples

PATTERN = "*.json*"


def keyed_source(spark: SparkSession, config: PrepConfig, schema: StructType, key: str) -> DataFrame:
    """The split of the source that the settings name: a JSON file, a folder of them, or a table with a ``key``."""
    source = config.data_source
    if not source:
        raise ValueError("data_source is empty")
    if source.lower().endswith(JSON_SUFFIXES) or source.endswith("/"):
        # read once: limit, split and encoding all go over the stored rows
        return stage(read_keyed_examples(spark, source, schema, config.split, PATTERN), "keyed").withColumnRenamed(
            "row_id", key)
    return read_table_examples(spark, source, config.split)


def training_batches(
    spark: SparkSession, config: PrepConfig, tokenizer: Tokenizer, schema: StructType = TRIPLE,
    key: str = "row_id", epoch: int = 0, drop_last: bool = False,
) -> DataFrame:
    """Columns split, batch_id, n_rows, input_ids, labels: the batches of one epoch.

    Rows are encoded and stored ragged. Only keys are ranked, and each epoch's order is arithmetic on the ranks. A batch
    is padded when it is complete: to ``max_seq_length``, or without one to its own longest row.
    """
    rows = keyed_source(spark, config, schema, key)
    done = stage(prepare(rows, config, tokenizer, [key], by_id(key), pad=False).select(
        key, "split", "input_ids", "labels"), "encoded")
    ranked = dense_rank(done.select(key, "split"), by_id(key), keys=["split"], total="total")
    placed = shuffle_ranked(ranked, config.seed, epoch).withColumn("rank", F.col("place"))
    numbered = assign_batches(placed, config.batch_size, drop_last).select(key, "batch_id", "row_in_batch")
    batches = collate(done.join(numbered, key), ["input_ids", "labels"], keys=["split"])
    return pad_batches(
        batches, {"input_ids": config.pad_id, "labels": config.ignore_index}, config.max_seq_length)
