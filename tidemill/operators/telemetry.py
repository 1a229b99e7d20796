"""Training logs, step schedules, throughput and checkpoint retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.segments import scan_keys

NUMBER = r"(-?(?:\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|nan|inf))"
INTEGER = r"(\d+)"

# Line layouts that trainers print.
STEP_LINE = rf"^Step {INTEGER} \| Train Loss: {NUMBER} \| Val Loss: {NUMBER} \|"
EPOCH_LINE = (
    rf"^Epoch {INTEGER}, Step {INTEGER}, Train Loss: {NUMBER}, Accuracy: {NUMBER}, "
    rf"Step Time: {NUMBER}s, Steps/sec: {NUMBER}"
)
TRAINING_LINE = rf"^Training \| (?:Epoch={INTEGER} \| )?Step={INTEGER} \| Loss={NUMBER}"
SERVICE_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) - (\S+) - ([A-Z]+) - ([\s\S]*)$"
STEP_SHIFT = 22


def _group(column: str, pattern: str, index: int, kind: str) -> Column:
    """A capture group, null when the line does not match."""
    found = F.regexp_extract(column, pattern, index)
    return F.nullif(found, F.lit("")).try_cast(kind)


def _parse(lines: DataFrame, column: str, pattern: str, groups: Sequence[tuple[str, str]]) -> DataFrame:
    matched = lines.withColumn("matched", F.regexp_like(column, F.lit(pattern)))
    return matched.withColumns(
        {n: _group(column, pattern, i + 1, k) for i, (n, k) in enumerate(groups)})


def parse_step_log(lines: DataFrame, column: str = "value") -> DataFrame:
    return _parse(lines, column, STEP_LINE, [
        ("step", "bigint"), ("train_loss", "double"), ("val_loss", "double")])


def parse_epoch_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Either of the two epoch layouts; fields that a layout lacks are null."""
    full, short = EPOCH_LINE, TRAINING_LINE
    both = {"epoch": (1, 1, "bigint"), "step": (2, 2, "bigint"), "train_loss": (3, 3, "double")}
    only = {"accuracy": 4, "step_time": 5, "steps_per_sec": 6}
    layout = F.when(F.regexp_like(column, F.lit(full)), "epoch").when(
        F.regexp_like(column, F.lit(short)), "training").otherwise("unmatched")
    return lines.withColumn("layout", layout).withColumns({
        **{n: F.coalesce(_group(column, full, a, k), _group(column, short, b, k))
           for n, (a, b, k) in both.items()},
        **{n: _group(column, full, i, "double") for n, i in only.items()},
    })


def parse_service_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Service records, and the output of subprocesses by stream."""
    body = F.col(column)
    source = F.when(F.startswith(body, F.lit("STDOUT: ")), "stdout").when(
        F.startswith(body, F.lit("STDERR: ")), "stderr").when(
        F.regexp_like(column, F.lit(SERVICE_LINE)), "service").otherwise("unmatched")
    tagged = lines.withColumn("source", source)
    is_output = F.col("source").isin("stdout", "stderr")
    return tagged.withColumns({
        "asctime": _group(column, SERVICE_LINE, 1, "string"),
        "logger": _group(column, SERVICE_LINE, 2, "string"),
        "level": _group(column, SERVICE_LINE, 3, "string"),
        "message": F.when(is_output, F.substring(body, F.lit(9), F.length(body)))
        .when(F.col("source") == "service", F.regexp_extract(column, SERVICE_LINE, 4))
        .otherwise(body),
    })


def lagged_metrics(steps: DataFrame, run: str, step: str, columns: Sequence[str]) -> DataFrame:
    """Values of the step before, 0.0 at the first step of a run."""
    scanned = scan_keys(steps, keys=[run], order=step, shift=STEP_SHIFT,
                        previous={f"prev_{c}": F.col(c) for c in columns})
    return scanned.withColumns({f"prev_{c}": F.coalesce(f"prev_{c}", F.lit(0.0)) for c in columns})


def carry_forward_value(
    steps: DataFrame, run: str, step: str, column: str, out: str | None = None
) -> DataFrame:
    """The last reported value up to each step, 0.0 before the first one."""
    name = out or column
    scanned = scan_keys(steps, keys=[run], order=step, shift=STEP_SHIFT,
                        held={"__held": F.col(column)})
    return scanned.withColumn(name, F.coalesce("__held", F.lit(0.0))).drop("__held")


def step_schedule(
    steps: DataFrame, log_interval: int, eval_interval: int, save_interval: int,
    step: str = "step", last_step: Column | None = None,
) -> DataFrame:
    """What a loop does at each zero-based step; the last step is always saved."""
    number = F.col(step)

    def every(k: int) -> Column:
        return (number + 1) % k == 0 if k > 0 else F.lit(False)

    final = last_step if last_step is not None else steps.agg(F.max(step)).scalar()
    return steps.withColumns({
        "do_log": (number == 1) | every(log_interval),
        "do_eval": every(eval_interval),
        "do_save": every(save_interval) | (number == final),
    })


def step_rate(seconds: Column) -> Column:
    return F.try_divide(F.lit(1.0), seconds)


def throughput(steps: DataFrame, run: str, seconds: str) -> DataFrame:
    """Steps over total time, which is not the mean of the step rates."""
    return steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum(seconds).alias("total_seconds")
    ).withColumn("steps_per_sec", F.try_divide(
        F.col("n_steps").cast("double"), F.col("total_seconds").cast("double")))


def read_speed(
    reads: DataFrame, name: str = "name", size: str = "size_bytes", seconds: str = "seconds",
    pattern: str = "model-%.safetensors",
) -> DataFrame:
    """GiB per second over the files of one name pattern."""
    picked = reads.where(F.col(name).like(pattern)).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes"),
        F.sum(seconds).alias("total_seconds"))
    gib = F.col("total_bytes") / F.lit(1024.0**3)
    return picked.withColumn("gb_per_sec", F.try_divide(gib, F.col("total_seconds").cast("double")))


def retain_latest(df: DataFrame, run: str, step: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows per run.

    Spark cuts each run to ``keep`` rows per map task before the shuffle, so a run of any
    length sends few rows to its task.
    """
    newest = Window.partitionBy(run).orderBy(F.col(step).desc())
    return df.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= keep).drop("__n")


def latest_step(df: DataFrame, run: str, step: str) -> DataFrame:
    return df.groupBy(run).agg(F.max(step).alias("latest_step"))
