"""What the operators share: input columns, row numbers, bounded slices of text, mixing of hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import scratch_dir

#: A task works on this much text at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: A worker forgets its word table when it holds more words than this.
KNOWN_WORDS = 300_000
#: Longer words are not remembered.
KNOWN_WORD_BYTES = 64


def base_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names, so others cannot clash."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def stored(df: DataFrame, label: str, compression: str) -> DataFrame:
    """Like ``stage``, with a compression of its own."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows with about SLICE_BYTES of text; null texts are empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) \
            if len(column) else np.empty(0, np.int64)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > SLICE_BYTES:
                yield batch.slice(begin, i - begin), [t or b"" for t in column.slice(begin, i - begin).to_pylist()]
                begin, held = i, 0
            held += n + 64
        if begin < len(sizes):
            yield batch.slice(begin), [t or b"" for t in column.slice(begin).to_pylist()]


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """64-bit hash of each word. Hashing takes a third of the time of a look-up among remembered words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (multiply and shift, one to one)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of ``length`` consecutive words, given the words' hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) + words[k:k + n]
        out ^= out >> np.uint64(29)
    return scramble(out)
