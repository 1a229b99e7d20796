"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate, its target share of the mixture over its share of the input
(in characters, one more for each document). A document's count is the inverse of the Poisson
distribution with that rate, at a number in (0, 1) hashed from the seed and the doc_id; it is
repeated so often. The copies are then shuffled globally by a hash.

Cases: null texts are empty, a null source is a source of its own, a null doc_id hashes as the word
``null``. Equal rows get equal counts. No rows give no rows. All columns are kept; an input column
named like the copy column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many sources (short names and a table of doubles each) their rates are broadcast;
#: more are joined by shuffling.
BROADCAST_SOURCES = 2_000


def uniform(seed: int, key: Column) -> Column:
    """Number in (0, 1) with 52 random bits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """Distribution function at 0, 1, ... until its rest is far below 2 ** -52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, total: float) -> DataFrame:
    """Columns s, rate: how often a document of the source is wanted, on average.

    ``weights`` are target weights by source, others get none; without it a source weighs its size
    to the power ``exponent``. The mixture is ``total`` times as large as the input.
    """
    sizes = docs.groupBy("s").agg(F.sum("size").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(exponent)))
    else:
        given = F.lit(None).cast("double")
        for name, value in weights.items():
            given = F.when(F.col("s") == name, F.lit(float(value))).otherwise(given)
        weighed = sizes.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    sums = weighed.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))
    return weighed.join(F.broadcast(sums)).select(  # one row
        "s", (F.col("all") * total * F.col("weight") / F.col("weights") / F.col("size")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, total: float = 1.0,
        seed: int = 42, copy: str | None = "copy") -> DataFrame:
    """``docs`` with every row repeated by its count, in random order; ``copy`` numbers the copies from 0."""
    keys = docs.select(F.col("source").cast("string").alias("s"),
                       (F.coalesce(F.char_length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    rates = source_rates(keys, weights, exponent, total).filter("rate > 0").select(
        F.col("s"), poisson_cdf(F.col("rate")).alias("cdf"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    held = docs.select(F.struct("*").alias("doc"))
    drawn = held.join(rates, F.col("doc.source").cast("string").eqNullSafe(F.col("s"))).select(
        "doc", F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.col("doc.doc_id")))).alias("n"))
    copies = drawn.filter("n > 0").select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null")), F.col("nth"))
    shuffled = copies.withColumn("place", order).repartition("place").sortWithinPartitions("place")
    kept = [F.col(f"doc.`{name}`").alias(name) for name in docs.columns if name != copy]
    return shuffled.select(*kept, *([F.col("nth").alias(copy)] if copy else []))
