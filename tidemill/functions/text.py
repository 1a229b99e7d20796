"""Small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024


def humanize_size(size: Column) -> Column:
    """Byte count as B, KB, MB or GB, in powers of 1024 and with one decimal."""
    def scaled(unit: int, name: str) -> Column:
        # Ties go to the even digit; the formatter alone would round them up.
        return F.format_string(f"%.1f {name}", F.bround(size / F.lit(float(unit)), 1))

    return (
        F.when(size < KIB, F.format_string("%d B", size))
        .when(size < KIB**2, scaled(KIB, "KB"))
        .when(size < KIB**3, scaled(KIB**2, "MB"))
        .otherwise(scaled(KIB**3, "GB"))
    )


def hash_id(text: Column, digits: int = 12) -> Column:
    """Short id that depends on the text alone."""
    return F.substring(F.sha2(text, 256), 1, digits)


def day_of(ts: Column) -> Column:
    """Calendar day of a timestamp as text."""
    return F.date_format(ts, "yyyy-MM-dd")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without a zone count as session time."""
    return F.unix_micros(ts.cast("timestamp"))
