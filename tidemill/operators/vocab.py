"""Word vocabularies: build one from texts, and encode texts with it."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids below the first word: padding, start, end, unknown.
UNKNOWN_ID = 3
FIRST_WORD_ID = 4
WHITESPACE = r"[ \t\n\r]+"
# A vocabulary of this many words is some tens of megabytes, whatever the corpus.
MAX_BROADCAST_WORDS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITESPACE), "")


def build_vocab(df: DataFrame, column: str, size: int) -> DataFrame:
    """The ``size`` most frequent words with ids, the most frequent first.

    Counting aggregates before the shuffle, so a word that makes up a third of the corpus
    costs one row per map task. Ids are given out over the ``size`` kept words only.
    """
    counts = df.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    ordering = [F.col("n").desc(), F.col("word").asc()]
    top = counts.orderBy(*ordering).limit(size)
    rank = F.row_number().over(Window.orderBy(*ordering))
    return top.select("word", "n", (rank + (FIRST_WORD_ID - 1)).cast("int").alias("token_id"))


def encode_vocab(
    df: DataFrame, key: str, column: str, vocab: DataFrame, max_broadcast: int = MAX_BROADCAST_WORDS
) -> DataFrame:
    """Adds ``ids``: the word ids of each text in order, unknown words as ``UNKNOWN_ID``.

    A vocabulary within the broadcast bound is looked up in one map-side pass. Beyond it,
    the most frequent words up to the bound are still broadcast, and only the others are
    joined by a shuffle; those are rare, so no join key is hot. Either way the ids depend on
    the text alone, so ``key`` may repeat.
    """
    head = vocab.orderBy("token_id").limit(max_broadcast + 1).select("word", "token_id").toArrow()
    if head.num_rows <= max_broadcast:
        return _encode_in_place(df, column, head)
    return _encode_by_join(df, column, vocab, head.slice(0, max_broadcast))


def _encode_in_place(df: DataFrame, column: str, vocab: pa.Table) -> DataFrame:
    known = df.sparkSession.sparkContext.broadcast(
        (vocab["word"].combine_chunks(), vocab["token_id"].combine_chunks()))

    @F.arrow_udf("array<int>")
    def look_up(texts: pa.Array) -> pa.Array:
        vocabulary, ids = known.value
        position = pc.index_in(texts.flatten(), value_set=vocabulary)
        found = pc.fill_null(pc.take(ids, position), UNKNOWN_ID).cast(pa.int32())
        starts = texts.offsets
        return pa.ListArray.from_arrays(pc.subtract(starts, starts[0]), found)

    return df.withColumn("ids", look_up(words(F.col(column))))


def _encode_by_join(
    df: DataFrame, column: str, vocab: DataFrame, head: pa.Table
) -> DataFrame:
    spark = df.sparkSession
    frequent = spark.createDataFrame(head)
    rest = vocab.select("word", "token_id").join(
        F.broadcast(frequent.select("word")), "word", "left_anti")
    marked_df = df.withColumn("__text", F.md5(F.col(column)))
    tokens = marked_df.select("__text", F.posexplode(words(F.col(column))).alias("pos", "word"))
    marked = tokens.join(F.broadcast(frequent), "word", "left")
    direct = marked.where(F.col("token_id").isNotNull())
    looked_up = marked.where(F.col("token_id").isNull()).drop("token_id").join(rest, "word", "left")
    encoded = direct.unionByName(looked_up).select(
        "__text", "pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("token_id"))
    # One text per group, however many rows hold it: equal places are one, so a group is no
    # larger than the cell it came from.
    lists = encoded.groupBy("__text").agg(
        F.array_sort(F.collect_set(F.struct("pos", "token_id"))).alias("__t"))
    joined = marked_df.join(lists, "__text", "left")
    empty = F.array().cast("array<int>")
    return joined.withColumn("ids", F.coalesce(F.col("__t.token_id"), empty)).drop("__t", "__text")
