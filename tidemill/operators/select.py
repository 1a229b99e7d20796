"""Limits, field mapping, validation and name filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.order import Count, Ordering, mark_first

# What the service accepts.
SUPPORTED_MODELS = ("llama3_2-1b", "llama3_1-8b", "llama3_1-70b", "llama3_1-405b")
ACCELERATOR_TYPES = ("v3", "v5e", "v5p")
CORE_STEP, MIN_CORES, MAX_CORES = 8, 8, 1024

ENCODED = ("input_ids", "labels", "prompt_length", "response_length")


def take_first(df: DataFrame, ordering: Ordering, n: Count, repeated: bool = False) -> DataFrame:
    """The first ``n`` rows under an ordering, by a filter on the key of the n-th row."""
    return mark_first(df, ordering, n, "__first", repeated).where("__first").drop("__first")


def limit_examples(df: DataFrame, n: int | None, ordering: Ordering, repeated: bool = False) -> DataFrame:
    """At most ``n`` rows, the first ones under the ordering; all of them for None."""
    return df if n is None else take_first(df, ordering, F.lit(n).cast("bigint"), repeated)


def trim_to_global_batch(
    df: DataFrame, batch: int, devices: int, ordering: Ordering, max_examples: int | None = None,
    repeated: bool = False,
) -> DataFrame:
    """As many leading rows as fill whole batches on all devices."""
    unit = batch * devices

    def whole_batches(rows: Column) -> Column:
        usable = rows if max_examples is None else F.least(rows, F.lit(max_examples).cast("bigint"))
        return F.floor(usable / unit) * unit

    return take_first(df, ordering, whole_batches, repeated)


def map_fields(
    df: DataFrame, input_field: str, output_field: str, key: Sequence[str]
) -> DataFrame:
    """Canonical columns; a missing field fails when the plan is analysed."""
    return df.select(
        *key, F.col(input_field).alias("instruction"), F.col(output_field).alias("output"))


def keep_encoded(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return df.select(*key, *ENCODED)


def apply_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return df if fn is None else df.transform(fn)


def expand_epochs(df: DataFrame, epochs: int, num_steps: int | None = None) -> DataFrame:
    """Batches once per epoch; ``num_steps`` counts from the start of each epoch."""
    if epochs <= 0:
        return df.withColumn("epoch", F.lit(0)).where(F.lit(False))
    kept = df if not num_steps else df.where(F.col("batch_id") < num_steps)
    return kept.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition does not hold."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*failed))


def validate_requests(
    df: DataFrame, supported: Sequence[str] = SUPPORTED_MODELS, model: str = "model",
    dataset: Sequence[str] = ("dataset_id", "dataset_path"),
) -> DataFrame:
    """A request needs a supported model and at least one way to find its dataset."""
    has_data = F.coalesce(*[F.col(c).cast("string") for c in dataset]).isNotNull()
    return _validated(df, {
        "unsupported_model": F.col(model).isin(*supported), "missing_dataset": has_data})


def validate_accelerator(
    df: DataFrame, kind: str = "accelerator_type", cores: str = "cores"
) -> DataFrame:
    return _validated(df, {
        "accelerator_type": F.col(kind).isin(*ACCELERATOR_TYPES),
        "core_count": (F.col(cores) % CORE_STEP == 0) & F.col(cores).between(MIN_CORES, MAX_CORES),
    })


def _validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    checked = df.withColumn("reasons", reasons(rules))
    return checked.withColumn("valid", F.size("reasons") == 0)


def keyword_filter(
    df: DataFrame, column: str, positives: Sequence[str], negatives: Sequence[str] = ()
) -> DataFrame:
    """Rows whose text holds all of one list of words and none of the other."""
    keep = F.lit(True)
    for word in positives:
        keep = keep & F.contains(F.col(column), F.lit(word))
    for word in negatives:
        keep = keep & ~F.contains(F.col(column), F.lit(word))
    return df.where(keep)


def name_partition(
    df: DataFrame, column: str, needles: Sequence[str] = ("lora_A", "lora_B"), out: str = "selected"
) -> DataFrame:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(F.col(column), F.lit(needle))
    return df.withColumn(out, F.coalesce(hit, F.lit(False)))
