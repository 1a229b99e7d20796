"""Length statistics that are stored per part and merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import batching


def test_merged_median_is_within_the_rank_error(spark):
    """A third of all rows have one length, and the parts are unevenly large."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("n"),
        F.floor(F.sqrt("id")).alias("day"))
    merged = batching.merge_stats(batching.stats_parts(rows, F.col("n"), ["day"])).first()
    lengths = sorted(r["n"] for r in rows.collect())
    assert (merged["samples"], merged["max_length"]) == (len(lengths), lengths[-1])
    assert merged["avg_length"] == sum(lengths) / len(lengths)
    median, error = merged["median_length"], batching.RANK_ERROR * len(lengths)
    assert sum(n < median for n in lengths) <= len(lengths) / 2 + error
    assert sum(n <= median for n in lengths) >= len(lengths) / 2 - error


def test_no_rows_and_null_lengths(spark):
    rows = spark.createDataFrame([("a", None), ("a", 4), ("b", None)], "k string, n int")
    parts = batching.stats_parts(rows, F.col("n"), ["k"])
    merged = {r["k"]: r for r in batching.merge_stats(parts, ["k"]).collect()}
    assert (merged["a"]["samples"], merged["a"]["max_length"], merged["a"]["median_length"]) == (2, 4, 4)
    assert (merged["a"]["avg_length"], merged["b"]["avg_length"]) == (4.0, None)
    assert (merged["b"]["samples"], merged["b"]["max_length"], merged["b"]["median_length"]) == (1, None, None)
    none = batching.merge_stats(batching.stats_parts(rows.limit(0), F.col("n"), ["k"])).first()
    assert (none["samples"], none["median_length"]) == (None, None)
