"""Loss, accuracy and perplexity over per-token predictions.

All sums are partially aggregated before the shuffle, so a sequence or batch of any size
is spread over the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.segments import scan_keys

# Floors that keep the means defined for empty masks.
SEQUENCE_FLOOR = 1e-10
TOKEN_FLOOR = 1e-8

POSITION_SHIFT = 16


def token_nll(logits: Column, label: Column) -> Column:
    """Negative log-softmax of the label, computed against the largest logit."""
    values = logits.cast("array<double>")
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.element_at(values, label.cast("int") + 1)


def token_nll_sharded(
    pieces: DataFrame, keys: Sequence[str], first: str = "first", logits: str = "logits", label: str = "label",
) -> DataFrame:
    """Columns nll and correct per token, from pieces of its row of logits.

    A piece holds the logits of the classes from ``first`` on, so no array is as long as the vocabulary. It is reduced to its
    largest logit, the sum of exponentials in terms of that, and the label's logit if it is there; those of one token are
    brought to the largest of all and added. As with a whole row, of equal logits the first class counts.
    """
    values = F.col(logits).cast("array<double>")
    at = F.col(label).cast("bigint") - F.col(first)
    here = (at >= 0) & (at < F.size(logits))
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    reduced = pieces.where(F.size(logits) > 0).select(
        *keys, F.col(label).alias("__label"), top.alias("__top"),
        F.when(top > float("-inf"), total).otherwise(0.0).alias("__total"),
        (F.array_position(values, top) - 1 + F.col(first)).alias("__class"),
        F.when(here, F.get(values, at.cast("int"))).alias("__own"))
    per_token = reduced.groupBy(*keys).agg(
        F.max("__top").alias("__all"), F.collect_list(F.struct("__top", "__total")).alias("__parts"),
        F.max("__own").alias("__own"), F.max("__label").alias("__label"),
        F.max_by("__class", F.struct(F.col("__top"), -F.col("__class"))).alias("__class"))
    scaled = F.aggregate("__parts", F.lit(0.0), lambda acc, p: acc + F.when(
        p["__total"] > 0, p["__total"] * F.exp(p["__top"] - F.col("__all"))).otherwise(0.0))
    return per_token.select(
        *keys, (F.col("__all") + F.log(scaled) - F.col("__own")).alias("nll"),
        (F.col("__class") == F.col("__label")).cast("int").alias("correct"))


def is_correct(logits: Column, label: Column) -> Column:
    """The first largest logit is the label's."""
    return (F.array_position(logits, F.array_max(logits)) - 1 == label).cast("int")


def supervised_mask(label: Column, ignore_index: int = -100) -> Column:
    return (label != ignore_index).cast("int")


def mean_over_sequences(
    df: DataFrame, seq: str, value: Column, mask: Column, out: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Masked mean per sequence, then the mean of those."""
    per_seq = df.groupBy(*keys, seq).agg(
        F.sum(F.when(mask > 0, value).otherwise(0.0)).alias("__s"), F.sum(mask).alias("__n"))
    ratio = F.col("__s") / F.greatest(F.col("__n").cast("double"), F.lit(SEQUENCE_FLOOR))
    return per_seq.groupBy(*keys).agg(F.avg(ratio).alias(out))


def loss_seq_mean(df: DataFrame, seq: str, nll: str, mask: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return mean_over_sequences(df, seq, F.col(nll), F.col(mask), "loss", keys)


def accuracy_seq_mean(
    df: DataFrame, seq: str, correct: str, mask: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    return mean_over_sequences(
        df, seq, F.col(correct).cast("double"), F.col(mask), "accuracy", keys)


def loss_token_mean(df: DataFrame, nll: str, mask: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All tokens weigh the same, whatever sequence they are in."""
    total = F.sum(F.when(F.col(mask) > 0, F.col(nll)).otherwise(0.0))
    return df.groupBy(*keys).agg((total / (F.sum(mask) + TOKEN_FLOOR)).alias("loss"))


def shift_for_loss(df: DataFrame, seq: str, pos: str, label: str = "label", mask: str = "mask") -> DataFrame:
    """Pair each position's prediction with the label and mask of the next position."""
    scanned = scan_keys(
        df, keys=[seq], order=pos, shift=POSITION_SHIFT, following={
            "__more": F.lit(1), label: F.col(label), mask: F.col(mask)})
    return scanned.where(F.col("__more").isNotNull()).drop("__more")


def eval_mean(
    df: DataFrame, batch: str, seq: str, nll: str, correct: str, mask: str,
    max_eval_steps: int | None = None,
) -> DataFrame:
    """Mean of batch means over the first ``max_eval_steps`` batches (0 or None: all)."""
    kept = df.where(F.col(batch) < max_eval_steps) if max_eval_steps else df
    floor = F.greatest(F.col("__n").cast("double"), F.lit(SEQUENCE_FLOOR))
    per_seq = kept.groupBy(batch, seq).agg(
        F.sum(F.when(F.col(mask) > 0, F.col(nll)).otherwise(0.0)).alias("__l"),
        F.sum(F.when(F.col(mask) > 0, F.col(correct)).otherwise(0)).alias("__c"),
        F.sum(mask).alias("__n"))
    per_batch = per_seq.groupBy(batch).agg(
        F.avg(F.col("__l") / floor).alias("__l"), F.avg(F.col("__c") / floor).alias("__c"))
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("__l").alias("loss"),
        F.avg("__c").alias("accuracy"))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)
