"""Global positions: dense ranks, first-n cuts and exact splits without a global sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.segments import by_shift, nulls_lowest, running_sum

# 1,048,576 buckets of a uniform hash, and 1,024 of these
HASH_BUCKET_DIGITS, HASH_SHIFT = 5, 10
TIE, TIE_SHIFT = "__tie", 40  # 2**24 buckets of a row's own hash
COPIES = 1 << 20  # equal rows written by one task
ID_SHIFTS = (20, 42)


def shuffle_key(key: Sequence[str], seed: int, epoch: Column | int | None = None) -> Column:
    """Hex digest that orders rows at random, but the same way on every run."""
    parts = [F.lit(str(seed))]
    if epoch is not None:
        parts.append((epoch if isinstance(epoch, Column) else F.lit(epoch)).cast("string"))
    return F.md5(F.concat_ws(":", *parts, *[F.col(k).cast("string") for k in key]))


@dataclass(frozen=True)
class Ordering:
    """How rows are ordered, and how that order is cut into segments, finest first."""

    columns: tuple[str, ...]
    levels: tuple[dict[str, Column], ...]
    temporary: dict[str, Column] = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.temporary) if self.temporary else df


def by_hash(key: Sequence[str], seed: int, epoch: Column | int | None = None) -> Ordering:
    """Pseudo-random order. The digest is uniform, so its prefix gives even segments."""
    digits = F.substring("__h", 1, HASH_BUCKET_DIGITS)
    return Ordering(
        ("__h", *key),
        ({"__hb": F.conv(digits, 16, 10).cast("int")}, {"__hb_high": F.shiftright("__hb", HASH_SHIFT)}),
        {"__h": shuffle_key(key, seed, epoch)},
    )


def by_id(column: str, shifts: Sequence[int] = ID_SHIFTS) -> Ordering:
    """Ascending order of one unique integer id, dense or sparse.

    With the usual shifts a segment holds 2**20 rows at most, an upper one 2**22 segments,
    and there are 2**22 upper ones at most, whatever the ids look like.
    """
    return Ordering((column,), tuple(by_shift(column, *shifts)))


def by_id_pair(major: str, minor: str, shifts: Sequence[int] = ID_SHIFTS) -> Ordering:
    """Order by (major, minor); ``minor`` counts up within a major id, as turns do.

    A major id with many rows spans many segments.
    """
    finest = {"__maj": nulls_lowest(major), "__min": F.shiftright(nulls_lowest(minor), shifts[0])}
    return Ordering((major, minor), (finest, *by_shift("__maj", *shifts)))


def dense_rank(
    df: DataFrame, ordering: Ordering, out: str = "rank", keys: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row, per key or over the whole table.

    ``total`` names a column for the number of rows, which the counting yields anyway.
    """
    prepared = ordering.prepare(df)
    ranked = running_sum(
        prepared, F.lit(1).cast("bigint"), out,
        order=ordering.columns, levels=ordering.levels, keys=keys, total=total)
    return ranked.withColumn(out, F.col(out) - 1).drop(*ordering.temporary)


Count = Column | Callable[[Column], Column]


def _nth_group(rows: DataFrame, level: Sequence[str], wanted: Column) -> DataFrame:
    """One row: the group of ``level`` that holds the wanted row.

    ``rows`` have a weight ``__n``. ``__left`` says which row of the group is meant (1-based),
    ``__ties`` how many it has.
    """
    carried = [c for c in rows.columns if c == "__rest"]
    counts = rows.groupBy(*level, *carried).agg(F.sum("__n").alias("__n")).withColumn("__wanted", wanted)
    running = Window.orderBy(*level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto, wanted = F.col("__upto"), F.col("__wanted")
    return (
        counts.withColumn("__upto", F.sum("__n").over(running))
        .where((upto >= wanted) & (upto - F.col("__n") < wanted))
        .select(*level, (wanted - upto + F.col("__n")).alias("__left"), F.col("__n").alias("__ties")))


def _inside(rows: DataFrame, group: DataFrame, level: Sequence[str]) -> DataFrame:
    """The rows of the one group, with the place looked for as ``__rest``."""
    one = group.select(*[F.col(c).alias(f"__g_{c}") for c in level], F.col("__left").alias("__rest"))
    same = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in level]
    return (rows.drop("__rest").join(F.broadcast(one), reduce(and_, same))
            .drop(*[f"__g_{c}" for c in level]))


def nth_key(df: DataFrame, ordering: Ordering, n: Count, repeated: bool = False) -> DataFrame:
    """One row: struct ``at`` with the order columns of the n-th row (1-based) as ``bound``.

    ``n`` may be a function of the number of rows, and counts up to that number at most.
    ``at.ties`` rows have these values, of which the n-th row is number ``at.left``. Works
    down the segment levels: pick the segment the n-th row is in, and go on inside it. The
    finest segments are counted once, by a partial aggregate over the order columns; the
    upper levels add those counts up. The windows run over one row per segment, the last
    one over the different keys of one finest segment. With ``repeated``, rows of equal
    keys are told apart by the column ``__tie``, a hash. Empty when n is 0.
    """
    columns = list(dict.fromkeys(ordering.columns))
    rows = ordering.prepare(df).select(*columns, *([TIE] if repeated else []))
    names: list[list[str]] = []
    for level in ordering.levels:
        rows = rows.withColumns(dict(level))
        names.append(list(level))
    counts = rows.groupBy(*[c for level in names for c in level]).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.withColumn("__n", F.lit(1).cast("bigint"))

    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    wanted = F.least((n(total) if callable(n) else n).cast("bigint"), total)
    for level in reversed(names):
        group = _nth_group(counts, level, wanted)
        counts, wanted = _inside(counts, group, level), F.col("__rest")
    steps = [names[0], columns]
    if repeated:
        rows = rows.withColumn("__tie_high", F.shiftright(TIE, TIE_SHIFT))
        steps += [["__tie_high"], [TIE]]
    for above, level in zip(steps, steps[1:]):
        rows = _inside(rows, group, above)
        group = _nth_group(rows, level, wanted)
        if level is columns:
            bounds = group.select(F.struct(*columns).alias("bound"))
    if repeated:
        group = group.withColumn("bound", F.struct(bounds.scalar().alias("key"), TIE))
    else:
        group = group.withColumn("bound", F.struct(*columns))
    return group.select(F.struct(
        "bound", F.col("__left").alias("left"), F.col("__ties").alias("ties")).alias("at"))


def first_n(df: DataFrame, ordering: Ordering, n: Count) -> Column:
    """Predicate that holds for the first ``n`` rows of ``df`` under the ordering.

    The bound is a scalar subquery, so the predicate is a plain row filter: no shuffle of
    the rows themselves, and no join. Use it on a frame prepared with the ordering. Fails
    if the n-th row is one of several with its key, and not the last.
    """
    at = nth_key(df, ordering, n).scalar()
    chosen = F.struct(*dict.fromkeys(ordering.columns)) <= at["bound"]
    error = F.raise_error(F.lit(f"rows repeat in {', '.join(ordering.columns)}: say repeated=True"))
    return F.when(at["left"] < at["ties"], error.cast("boolean")).otherwise(F.coalesce(chosen, F.lit(False)))


def mark_first(df: DataFrame, ordering: Ordering, n: Count, out: str, repeated: bool = False) -> DataFrame:
    """Adds ``out``: whether a row is one of the first ``n`` under the ordering.

    ``repeated`` says that rows may have equal keys, or be equal altogether. Rows of equal
    keys are then taken in the order of a hash of the row. Of the equal rows that the cut
    goes through one is kept and written as often as needed on either side, which costs a
    second reading of the table.
    """
    temporary = [*ordering.temporary, TIE]
    if not repeated:
        return ordering.prepare(df).withColumn(out, first_n(df, ordering, n)).drop(*temporary)
    tied = df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    at = nth_key(tied, ordering, n, repeated=True).scalar()
    place = F.struct(F.struct(*dict.fromkeys(ordering.columns)), TIE)
    rows = ordering.prepare(tied)
    sure = rows.where(~place.eqNullSafe(at["bound"])).withColumn(
        out, F.coalesce(place < at["bound"], F.lit(False)))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((at["ties"] - 1) / COPIES)))
    first = F.col("__block") * COPIES + 1
    copies = (
        rows.where(place.eqNullSafe(at["bound"])).agg(F.any_value(F.struct(*df.columns)).alias("__row"))
        .select("__row", blocks.alias("__block")).repartition("__block")
        .select("__row", F.explode(F.sequence(first, F.least(first + COPIES - 1, at["ties"]))).alias("__copy"))
        .select("__row.*", (F.col("__copy") <= at["left"]).alias(out)))
    return sure.drop(*temporary).unionByName(copies)
