"""Log files and hardware metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.segments import scan_keys

HW_COLUMNS = ("timestamp", "step", "gpu_utilization", "memory_used", "memory_total")
LINE_SHIFT = 20


def with_offsets(lines: DataFrame, keys: Sequence[str] = ("file",), order: str = "line_no") -> DataFrame:
    """Byte positions of each line in its file, line ends included."""
    size = (F.octet_length("value") + 1).cast("bigint")
    ends = scan_keys(lines, keys=keys, order=order, shift=LINE_SHIFT, sums={"end_byte": size})
    return ends.withColumn("start_byte", F.col("end_byte") - size)


def log_from_offset(
    lines: DataFrame, start_byte: int, keys: Sequence[str] = ("file",), order: str = "line_no"
) -> DataFrame:
    """Lines that reach beyond a byte position; a line cut by it comes from there on,
    or from the next character if the position lies within one.

    Files that end at or before the position are out of range and give no row.
    """
    reached = with_offsets(lines, keys, order).where(F.col("end_byte") > start_byte)
    skipped = F.greatest(F.lit(start_byte) - F.col("start_byte"), F.lit(0)).cast("int")
    rest = F.hex(F.substring(F.encode("value", "UTF-8"), skipped + 1, F.octet_length("value")))
    # bytes 80 to BF go on with a character that began before
    tail = F.decode(F.unhex(F.regexp_replace(rest, "^(?:[89AB][0-9A-F]){1,3}", "")), "UTF-8")
    return reached.withColumn("value", F.when(skipped > 0, tail).otherwise(F.col("value")))


def out_of_range(
    lines: DataFrame, start_byte: int, keys: Sequence[str] = ("file",)
) -> DataFrame:
    """Files for which a read position lies behind the end."""
    sizes = lines.groupBy(*keys).agg(
        F.sum(F.octet_length("value") + 1).cast("bigint").alias("file_bytes"))
    return sizes.where(F.col("file_bytes") <= start_byte)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of log segments as they are rolled into a folder."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )


def _numeric(column: Column, pattern: str) -> Column:
    return F.regexp_like(F.trim(column), F.lit(pattern))


def parse_hw_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """``status`` is 'metrics', 'raw' or 'rejected'.

    The header names five fields, but a collector may write its raw output behind time
    and step. Five numeric fields are metrics, any other text behind a numeric time and
    step is a raw line, and the rest is rejected with the line kept.
    """
    number, integer = r"^-?\d+(\.\d+)?$", r"^\d+$"
    fields = F.split(column, ",", 3)
    rest = F.split(F.get(fields, F.lit(2)), ",")
    prefixed = (
        (F.size(fields) == 3) & _numeric(fields[0], number)
        & _numeric(F.get(fields, F.lit(1)), integer))
    measured = prefixed & (F.size(rest) == 3) & F.forall(rest, lambda f: _numeric(f, number))
    status = F.when(measured, "metrics").when(prefixed, "raw").otherwise("rejected")
    parsed = lines.where(F.col(column) != ",".join(HW_COLUMNS)).withColumn("status", status)

    def value(expr: Column, kind: str, *statuses: str) -> Column:
        return F.when(F.col("status").isin(*statuses), F.trim(expr)).try_cast(kind)

    return parsed.withColumns({
        "timestamp": value(fields[0], "double", "metrics", "raw"),
        "step": value(F.get(fields, F.lit(1)), "bigint", "metrics", "raw"),
        **{n: value(F.get(rest, F.lit(i)), "double", "metrics")
           for i, n in enumerate(HW_COLUMNS[2:])},
        "raw_line": F.when(F.col("status") == "raw", F.get(fields, F.lit(2))),
    })


def read_hw_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the lines that could not be parsed."""
    rows = parse_hw_metrics(spark.read.text(path))
    return rows.where("status <> 'rejected'").drop("value"), rows.where(
        "status = 'rejected'").select("value")
