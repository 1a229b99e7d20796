"""Catalog tables: change logs, upserts, lookups, checks and cascades.

The newest row per id is found with ``max_by``, which aggregates before the shuffle; an
id with a great many versions costs one row per map task. Of rows with one id and one sequence number the
largest by their other columns counts, whatever the order they come in. Null is an id like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def list_view(df: DataFrame, columns: dict[str, str], created: str = "created_at") -> DataFrame:
    """Renamed columns and the calendar day of creation."""
    return df.select(
        *[F.col(c).alias(n) for n, c in columns.items()],
        F.date_format(created, "yyyy-MM-dd").alias("created"))


def catalog_list(df: DataFrame) -> DataFrame:
    return df.select("*")


def catalog_get(df: DataFrame, id_col: str, value: object, seq_col: str) -> DataFrame:
    """The earliest row with the id; no row when there is none."""
    return df.where(F.col(id_col) == F.lit(value)).orderBy(seq_col, tie_break(df, df.columns)).limit(1)


def catalog_append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def catalog_remove(df: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    return df.join(keys.select(id_col), id_col, "left_anti")


def age(seq_col: str) -> Column:
    """Order of changes that has a place for a null sequence number."""
    return F.struct(F.col(seq_col).isNotNull(), F.col(seq_col))


def has_order(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(has_order(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return has_order(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def tie_break(df: DataFrame, columns: Sequence[str]) -> Column:
    """An order among rows that are equal otherwise; columns without an order of their own go by their JSON text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.col(f"`{c}`") if has_order(types[c]) else F.to_json(F.struct(F.col(f"`{c}`"))) for c in columns]
    return F.struct(*(parts or [F.lit(0)]))


def latest(df: DataFrame, key: Sequence[str], seq_col: str) -> DataFrame:
    """Newest row per key; rows without a sequence number are older than all others."""
    rest = [c for c in df.columns if c not in key]
    if all(has_order(df.schema[c].dataType) for c in rest):  # the row is its own tie break
        row = F.max(F.struct(age(seq_col).alias("__age"), *[F.col(f"`{c}`") for c in rest]))
    else:
        row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(age(seq_col), tie_break(df, rest)))
    newest = df.groupBy(*key).agg(row.alias("__row"))
    return newest.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def catalog_upsert(df: DataFrame, changes: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """Remove and append: the newest change replaces all rows of its id."""
    newest = latest(changes, [id_col], seq_col)
    ids = newest.select(F.col(id_col).alias("__id"))
    return df.join(ids, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti").unionByName(newest)


def kv_latest(changes: DataFrame, key: str = "key", value: str = "value", seq_col: str = "seq") -> DataFrame:
    """Current key-value index from a change log; a null value removes the key."""
    order = F.struct(age(seq_col), tie_break(changes, [value]))
    newest = changes.groupBy(key).agg(F.max_by(F.struct(value), order).alias("__v"))
    return newest.select(key, F.col(f"__v.{value}").alias(value)).where(F.col(value).isNotNull())


def status_sync(
    catalog: DataFrame, statuses: DataFrame, id_col: str, status: str = "status",
    updated: str = "updated_at",
) -> DataFrame:
    """Catalog rows with the newest reported status, their own where none was reported.

    A report without a time is older than all others, and leaves the catalog's time as it is.
    """
    order = F.struct(age(updated), tie_break(statuses, [status]))
    newest = statuses.where(F.col(status).isNotNull()).groupBy(id_col).agg(
        F.max_by(F.struct(status, updated), order).alias("__new"))
    return catalog.join(newest, id_col, "left").withColumns({
        status: F.coalesce(f"__new.{status}", F.col(status)),
        updated: F.coalesce(f"__new.{updated}", F.col(updated)),
    }).drop("__new")


def valid_refs(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    return df.join(ref.select(key), key, "left_semi")


def orphan_refs(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    return df.join(ref.select(key), key, "left_anti")


def resolve_dataset_path(
    requests: DataFrame, datasets: DataFrame, base: str, id_col: str = "dataset_id",
    explicit: str = "dataset_path", file_name: str = "file_name",
) -> DataFrame:
    """An explicit path wins, else the catalog's file below the base folder."""
    found = datasets.select(id_col, F.col(file_name).alias("__f"))
    path = F.concat(F.lit(base.rstrip("/") + "/"), F.col("__f"))
    return requests.join(found, id_col, "left").withColumn(
        "resolved_path", F.coalesce(F.col(explicit), path)).drop("__f")


def job_view(
    tunes: DataFrame, models: DataFrame, datasets: DataFrame, accelerators: DataFrame,
    model_id: str = "model_id", dataset_id: str = "dataset_id", accelerator_id: str = "accelerator_id",
) -> DataFrame:
    """Jobs with everything they refer to; unknown references leave nulls.

    The side tables are deduplicated by their keys' contract, so no join adds rows. Which
    of them are broadcast is left to the measured sizes.
    """
    return (
        tunes.join(models, model_id, "left")
        .join(datasets, dataset_id, "left")
        .join(accelerators, accelerator_id, "left")
    )


def lookup_default(key: Column, mapping: dict[str, str], default: Column | str | None = None) -> Column:
    """Value of a small fixed mapping; unknown keys give the default, or themselves."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    fallback = key if default is None else default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(known, key), fallback)


def map_status(df: DataFrame, column: str, mapping: dict[str, str], default: str = "unknown",
               out: str = "status") -> DataFrame:
    return df.withColumn(out, F.coalesce(
        F.when(F.col(column).isNotNull(), lookup_default(F.col(column), mapping, default)),
        F.lit(default)))


def split_lookup(df: DataFrame, name_col: str, table: DataFrame, sep: str = "-") -> DataFrame:
    """Family and size from a name, and the table's row for the two, null if there is none."""
    parts = F.split(name_col, sep)
    named = df.withColumns({"family": F.lower(parts[0]), "size": F.get(parts, F.lit(1))})
    return named.join(table, ["family", "size"], "left")


def explode_regions(locations: DataFrame, regions: str = "regions") -> DataFrame:
    """One row per region of a nested location list."""
    others = [c for c in locations.columns if c != regions]
    return locations.select(*others, F.explode(regions).alias("region"))


def default_zone(region: Column, known: Column) -> Column:
    return F.concat(region, F.when(known, "-b").otherwise("-a"))


def merge_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Requested values over defaults, column by column."""
    return df.withColumns({
        n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v)
        for n, v in defaults.items()})


def merge_maps(defaults: Column, requested: Column) -> Column:
    """Free-form settings: requested entries win, other defaults stay."""
    given = F.coalesce(requested, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested fields as columns that carry their whole path in the name."""
    def leaves(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, StructType):
                out += leaves(field.dataType, here)
            else:
                source = ".".join(f"`{p}`" for p in here)
                out.append(F.col(source).alias(sep.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def index_by(df: DataFrame, key: str, id_col: str, shift: int = 12) -> DataFrame:
    """Secondary index as posting blocks: ids per key, in blocks of 2**shift id values.

    A key that covers much of the table has many blocks rather than one huge array.
    """
    block = F.shiftright(F.col(id_col).cast("bigint"), shift)
    return df.groupBy(key, block.alias("block_no")).agg(
        F.array_sort(F.collect_list(id_col)).alias("ids"))


def cascade_delete(
    tables: Sequence[tuple[DataFrame, str, str | None]], deleted: DataFrame
) -> list[DataFrame]:
    """What is left of a chain of tables when rows of the first one go.

    Each entry is (table, column that refers to the entry before, own key or None). Rows
    that refer to a deleted row are deleted too, and so on down the chain.
    """
    left: list[DataFrame] = []
    gone = deleted
    for df, ref, own in tables:
        keys = gone.toDF("__gone")
        left.append(df.join(keys, F.col(ref) == F.col("__gone"), "left_anti"))
        if own is not None:
            gone = df.join(keys, F.col(ref) == F.col("__gone"), "left_semi").select(own)
    return left


def insert_if_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows whose key is new; of several with one new key the first by their JSON text."""
    rest = [c for c in rows.columns if c != key]
    whole = F.struct(*rest)
    once = rows.groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select(key, "__row.*")
    there = df.select(F.col(key).alias("__key"))
    return df.unionByName(once.join(there, F.col(key).eqNullSafe(F.col("__key")), "left_anti"))


def stop_jobs(
    df: DataFrame, keys: DataFrame, id_col: str, now: Column, status: str = "status",
    updated: str = "updated_at", new_status: str = "stopping",
) -> DataFrame:
    """Status and time of the named jobs; used on the catalog and the status table alike."""
    chosen = keys.select(id_col).distinct().withColumn("__stop", F.lit(True))
    hit = F.col("__stop").isNotNull()
    return df.join(chosen, id_col, "left").withColumns({
        status: F.when(hit, new_status).otherwise(F.col(status)),
        updated: F.when(hit, now).otherwise(F.col(updated)),
    }).drop("__stop")
