"""From raw documents to packed training sequences: five stages, each stored and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import line_dedup, mixing, packing, quality, shingle_join
from tidemill.session import stage, table


#: Lines within so many edits of an earlier one go, as in op6_line_edit_dedup.
LINE_EDITS = 2
#: Words that a packing worker remembers (twice): by then the workers hold what earlier stages left.
PACKING_WORDS = 150_000


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with the length of a changed text."""
    return docs.select(*[F.char_length("text").cast("long").alias("n_chars") if name == "n_chars"
                         else F.col(f"`{name}`") for name in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; documents that fail the base rules, or that are left with too little, go whole."""
    return with_length(quality.clean(docs).filter("kept"), docs.columns)


def line_edit_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents that lose lines and have no word left go with them."""
    deduped = line_dedup.dedup_lines(docs, edits=LINE_EDITS).filter(
        F.expr("n_removed = 0") | F.col("text").rlike("[^ \t\n\r\x0B\f]"))
    return with_length(deduped, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return shingle_join.one_of_each(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to weights that grow with the square root of their size."""
    return mixing.mix(docs, exponent=0.5, total=1.0, copy=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048,
                                  table_words=PACKING_WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_edit_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: SQL cannot express the tokenizer and the genetic packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
