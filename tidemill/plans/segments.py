"""Running computations over keys of any size.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task. If
one key holds a third of the table, so does one task. The functions below cut each key
into *segments*, i.e. consecutive stretches of the order column, and work on two levels:

* one small row per (key, segment), built by a partially aggregated ``groupBy``, tells
  what enters the segment from the left (or from the right);
* the window itself is partitioned by (key, segment).

Segments are computed from the order value alone, so the same row always gets the same
segment, also when a lost executor's work is run again. The carry table is joined on
(key, segment), the partitioning the window already has; adaptive execution turns that
join into a broadcast one only when the measured size allows it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType

Levels = Sequence[dict[str, Column]]


def nulls_lowest(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(-2**63))


def by_shift(order: str, *shifts: int) -> list[dict[str, Column]]:
    """Segment levels for one integer order column: ``order >> shift``, finest first.

    Nulls come first in an order, so they share the segment of the lowest integer.
    """
    levels: list[dict[str, Column]] = []
    source, taken = order, 0
    for shift in shifts:
        name = f"__seg{shift}"
        levels.append({name: F.shiftright(nulls_lowest(source), shift - taken)})
        source, taken = name, shift
    return levels


def _flatten_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """Keys as columns without nulls, and how to get the original ones back.

    Window, aggregate and join then share one partitioning by plain equality. A null-safe
    comparison would cost the join a shuffle of its own, and one struct of all keys would
    make for slow sorts. ``__nulls`` has a bit per key that was null.
    """
    if not keys:
        return df, [], {}
    types = {f.name: f.dataType for f in df.schema.fields}
    flat = {f"__key{i}": F.coalesce(F.col(k), _stand_in(types[k])) for i, k in enumerate(keys)}
    bits = [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)]
    marked = df.withColumns({**flat, "__nulls": reduce(add, bits)})
    restored = {
        k: F.when(F.col("__nulls").bitwiseAND(1 << i) == 0, F.col(f"__key{i}"))
        for i, k in enumerate(keys)}
    return marked, [*flat, "__nulls"], restored


def _stand_in(kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.lit("")
    if isinstance(kind, DateType):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(0).cast(kind)


def _per(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names] or [F.lit(0)]


def running_sum(
    df: DataFrame,
    value: Column,
    out: str,
    *,
    order: Sequence[str],
    levels: Levels,
    keys: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key, in the sequence given by ``order``.

    ``levels`` lists the segment columns, finest first; each level is expressed over the
    columns of the level before it. ``order`` has to be unique within a key. ``total``
    names a column for the sum over the whole key.
    """
    marked, flat, restored = _flatten_keys(df.withColumn("__v", value), list(keys))
    summed = _summed(marked, "__v", out, order, levels, flat)
    kept = [restored.get(c, F.col(c)).alias(c) for c in df.columns if c not in (out, total)]
    return summed.select(*kept, out, *([F.col(WHOLE_KEY).alias(total)] if total else []))


WHOLE_KEY = "__whole"


def _summed(
    df: DataFrame, value: str, out: str, order: Sequence[str], levels: Levels, keys: list[str]
) -> DataFrame:
    if not levels:
        key = Window.partitionBy(*_per(keys))
        running = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*", F.sum(value).over(running).alias(out), F.sum(value).over(key).alias(WHOLE_KEY))

    finest, upper = levels[0], levels[1:]
    total, upto, carry = (f"__{n}{len(levels)}" for n in ("t", "u", "c"))
    marked = df.withColumns(dict(finest))
    group = [*keys, *finest]
    totals = marked.groupBy(*group).agg(F.sum(value).alias(total))
    carried = _summed(totals, total, upto, list(finest), upper, keys).select(
        *group, (F.col(upto) - F.col(total)).alias(carry), WHOLE_KEY)
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = marked.withColumn(out, F.sum(value).over(window))
    return inside.join(carried, group, "left").withColumn(
        out, F.col(out) + F.col(carry)).drop(carry)


def scan_keys(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    shift: int,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    held: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    collected: dict[str, Column] | None = None,
) -> DataFrame:
    """Several ordered computations per key, with one window over the rows.

    ``previous`` / ``following``: value of the row before / after, null where there is
    none. ``held``: last non-null value up to and including the row. ``sums``: inclusive
    running sum. ``collected``: array of the values before the row within its segment.
    ``order`` is an integer column without nulls, unique per key; a segment spans
    ``2**shift`` order values. Numbers are carried by hash aggregates; text needs a sort
    before the partial aggregate, so a plan should ask for text only where it uses it.
    """
    keys = list(keys)
    previous, following = previous or {}, following or {}
    held, sums, collected = held or {}, sums or {}, collected or {}
    at = F.col(order)
    marked, flat, restored = _flatten_keys(df.withColumns({
        "__seg": F.shiftright(at.cast("bigint"), shift),
        **{f"__v_{n}": v for n, v in
           {**previous, **following, **held, **sums, **collected}.items()}}), keys)
    group = [*flat, "__seg"]

    inside = Window.partitionBy(*group).orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {n: F.lag(f"__v_{n}").over(inside) for n in previous}
    local |= {n: F.lead(f"__v_{n}").over(inside) for n in following}
    local |= {n: F.last(f"__v_{n}", ignorenulls=True).over(running) for n in held}
    local |= {n: F.sum(f"__v_{n}").over(running) for n in sums}
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local |= {n: F.collect_list(f"__v_{n}").over(earlier) for n in collected}
    windowed = marked.select(
        "*", *[c.alias(f"__o_{n}") for n, c in local.items()],
        F.lag(order).over(inside).isNotNull().alias("__has_previous"),
        F.lead(order).over(inside).isNotNull().alias("__has_following"))

    joined = windowed
    for carry in _carries(marked, flat, order, shift, previous, following, held, sums):
        joined = joined.join(carry, group, "left")
    out = {n: F.when(F.col("__has_previous"), F.col(f"__o_{n}")).otherwise(F.col(f"__in_{n}"))
           for n in previous}
    out |= {n: F.when(F.col("__has_following"), F.col(f"__o_{n}")).otherwise(F.col(f"__in_{n}"))
            for n in following}
    out |= {n: F.coalesce(f"__o_{n}", f"__in_{n}") for n in held}
    out |= {n: F.coalesce(F.col(f"__o_{n}") + F.col(f"__in_{n}"), f"__o_{n}", f"__in_{n}")
            for n in sums}
    out |= {n: F.col(f"__o_{n}") for n in collected}
    kept = [restored.get(c, F.col(c)).alias(c) for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])


def _carries(
    marked: DataFrame, flat: list[str], order: str, shift: int, previous: Iterable[str],
    following: Iterable[str], held: Iterable[str], sums: Iterable[str],
) -> Iterator[DataFrame]:
    """Tables of what enters each (key, segment) from other segments of the key."""
    group, at = [*flat, "__seg"], F.col(order)
    across = Window.partitionBy(*_per(flat)).orderBy("__seg")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max_by(f"__v_{n}", at) for n in previous}
    first = {n: F.min_by(f"__v_{n}", at) for n in following}
    newest = {n: F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)) for n in held}
    totals = {n: F.sum(f"__v_{n}") for n in sums}

    def edges(rows: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
        return rows.groupBy(*group).agg(*[e.alias(f"__e_{n}") for n, e in aggregates.items()])

    if last or totals:
        carried = {n: F.lag(f"__e_{n}").over(across) for n in last}
        carried |= {n: F.sum(f"__e_{n}").over(before) for n in totals}
        yield edges(marked, {**last, **totals}).select(
            *group, *[c.alias(f"__in_{n}") for n, c in carried.items()])
    if not (first or newest):
        return

    # No row of the table's lowest segment follows another segment, and that segment
    # inherits nothing. Mostly it is the only one, and then few rows get past the filters.
    lowest = F.shiftright(marked.agg(F.min(at.cast("bigint"))).scalar(), shift)
    later = F.col("__seg") > lowest
    if first:
        target = F.coalesce(F.lag("__seg").over(across), lowest)
        yield edges(marked.where(later), first).select(
            *flat, target.alias("__seg"), *[F.col(f"__e_{n}").alias(f"__in_{n}") for n in first])
    if newest:
        known = reduce(or_, [F.col(f"__v_{n}").isNotNull() for n in newest])
        carried = {n: F.last(f"__e_{n}", ignorenulls=True).over(before) for n in newest}
        yield edges(marked.where(later | known), newest).select(
            *group, *[c.alias(f"__in_{n}") for n, c in carried.items()])
