"""Exact train/test split and epoch order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.order import Ordering, by_hash, dense_rank, mark_first


def train_test_split(
    df: DataFrame, key: Sequence[str], fraction: float = 0.15, seed: int = 42,
    repeated: bool = False,
) -> DataFrame:
    """Adds ``split``: exactly ``ceil(fraction * n)`` test rows, the rest train.

    Membership depends on the key and the seed only. Where keys repeat, say ``repeated``. The rows are not moved: the split
    point is found on the keys, and the label is a map-side comparison with it.
    """
    marked = mark_first(
        df, by_hash(key, seed), lambda rows: F.ceil(F.lit(float(fraction)) * rows), "__test", repeated)
    return marked.withColumn(
        "split", F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train"))).drop("__test")


def shuffle_order(
    df: DataFrame, ordering: Ordering, key: Sequence[str], seed: int, epoch: int = 0,
    enabled: bool = True, keys: Sequence[str] = (),
) -> DataFrame:
    """Adds ``rank``: a new pseudo-random order per epoch, or the given one when off."""
    chosen = by_hash(key, seed, epoch) if enabled else ordering
    return dense_rank(df, chosen, "rank", keys)


PRIME = (1 << 31) - 1
SWAP_ROUNDS = 48


def mixed(x):
    return (x * x + (x >> 3) + 40692) % PRIME


def only(values: pa.Array) -> np.ndarray | int:
    """A column without nulls as numbers, or as one number if it holds no other."""
    numbers = values.to_numpy(zero_copy_only=False)
    return int(numbers[0]) if len(numbers) and (numbers == numbers[0]).all() else numbers


def swapped(place: np.ndarray, whole: np.ndarray | int, epoch: np.ndarray | int, seed: int, rounds: int) -> np.ndarray:
    """Numbers below ``whole`` after all rounds; what depends on the round alone is worked out once for all of them."""
    key = (seed % PRIME * 48271 + epoch % PRIME * 69621) % PRIME
    long = np.max(whole) > 1 << 31
    for r in range(1, rounds + 1):
        own = mixed(mixed((key + r * 39373) % PRIME))
        mirror = ((own * PRIME + mixed(own + 1)) % whole - place) % whole
        larger = np.maximum(place, mirror)
        high = (larger >> 31) * 742938285 % PRIME if long else 0
        decides = mixed(mixed((larger % PRIME + high + own) % PRIME))
        place = np.where((decides >> 11) % 2 == 1, mirror, place)
    return place


def epoch_place(rank: Column, rows: Column | int, seed: int, epoch: Column | int = 0,
                rounds: int = SWAP_ROUNDS) -> Column:
    """A keyed permutation of 0 to ``rows`` - 1, a new one per seed and epoch, by arithmetic alone.

    In each round a number and its mirror image about a point that depends on the round change places or not; a hash of
    the larger of the two decides, so both decide alike and every round is one to one. With the rank of
    each row known once, any epoch's order is a projection: nothing is ranked or moved again. Good for up to 2**62 rows.
    The rounds go over batches of rows as arrays.
    """
    @F.arrow_udf("bigint")
    def place(ranks: pa.Array, whole: pa.Array, epochs: pa.Array) -> pa.Array:
        known = pc.and_(pc.and_(ranks.is_valid(), whole.is_valid()), epochs.is_valid())
        taken = [only(c.filter(known)) for c in (whole, epochs)]
        places = swapped(ranks.filter(known).to_numpy(zero_copy_only=False), *taken, seed, rounds) \
            if pc.any(known).as_py() else np.empty(0, np.int64)
        out = np.zeros(len(ranks), np.int64)
        missing = ~known.to_numpy(zero_copy_only=False)
        out[~missing] = places
        return pa.array(out, mask=missing)

    whole = F.lit(rows) if isinstance(rows, int) else rows
    number = F.lit(epoch) if isinstance(epoch, int) else epoch
    return place(rank.cast("bigint"), whole.cast("bigint"), number.cast("bigint"))


def shuffle_ranked(df: DataFrame, seed: int, epoch: int, rank: str = "rank", rows: str = "total",
                   out: str = "place") -> DataFrame:
    """Adds the place of every row in an epoch's order, from its rank and the number of rows."""
    return df.withColumn(out, epoch_place(F.col(rank), F.col(rows), seed, epoch))
