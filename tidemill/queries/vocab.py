"""Vocabulary queries over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import vocab
from tidemill.queries.registry import query
from tidemill.session import table

SIZE = 8000

VOCAB = f"""words AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws
  FROM documents),
tokens AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM words),
counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
vocab AS (SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS token_id FROM counts
  QUALIFY row_number() OVER (ORDER BY n DESC, word) <= {SIZE})"""
ENCODED = f"""WITH {VOCAB}, ids AS (SELECT doc_id, pos, coalesce(token_id, 3) AS token_id FROM tokens LEFT JOIN vocab
  USING (word))
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, md5(CAST(list(token_id ORDER BY pos) AS VARCHAR)) AS digest
FROM ids GROUP BY doc_id"""


@query(f"WITH {VOCAB} SELECT word, n, token_id FROM vocab")
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.build_vocab(table(spark, sf, "documents"), "text", SIZE)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").alias("n_tokens"), F.md5(F.col("ids").cast("string")).alias("digest"))


@query(ENCODED)
def vocab_encode(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return digest(vocab.encode_vocab(docs, "doc_id", "text", vocab.build_vocab(docs, "text", SIZE)))


@query(ENCODED)
def vocab_encode_join(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken by vocabularies beyond the broadcast bound."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = vocab.build_vocab(docs, "text", SIZE)
    return digest(vocab.encode_vocab(docs, "doc_id", "text", known, max_broadcast=500))
