"""Quality rules for documents, with line frequencies across the documents of a host.

Base rules look at one text. The method's rule hashes normalised lines (A-Z lower-cased, runs of
ASCII white space as one space) and counts the documents of each host that hold a line. A line is
*frequent* on a host when more than ``most`` of its documents hold it, however many the host has;
it is then removed from all of them but the one with the least doc_id. A document of which less than
``left_words`` words and less than ``left_share`` of its words are left is depleted and rejected.

Cases: null texts are empty, and fail for having too few words. A null host is a host of its own.
Rows count as separate documents, but rows that share a doc_id keep a line together. No rows give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.line_dedup import small_or_not
from tidemill.llm.rows import base_columns, slices
from tidemill.session import stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

HASHES = "doc_id long, th long, host string, lines array<long>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words")
MADE = "struct<" + ", ".join(f"{name}: bigint" for name in FIGURES) + ", rest: binary>"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:  # equal numbers for equal runs, of doubled width
        step = min(width, window - width)
        _, ids = np.unique(ids[:-step] * len(words) + ids[step:], return_inverse=True)
        width += step
    counts = np.bincount(ids)
    at = np.flatnonzero(counts[ids] > 1)
    if not len(at):
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def line_hash(line: bytes) -> int | None:
    """Hash of the normalised line, None without a word."""
    words = line.translate(LOWER).split()
    if not words:
        return None
    key = xxhash.xxh3_64_intdigest(b" ".join(words))
    return key - ((key >> 63) << 64)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keys(host: str) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"),
            F.col(f"`{host}`").cast("string").alias("host")]


def line_hashes(docs: DataFrame, host: str) -> DataFrame:
    """Hashes of the distinct normalised lines of every document, stored, with a hash of the text."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            lines = [list({h for x in set(text.split(b"\n")) if (h := line_hash(x)) is not None}) for text in texts]
            yield pa.record_batch([*batch.columns[:3], pa.array(lines, pa.list_(pa.int64()))],
                                  names=["doc_id", "th", "host", "lines"])

    return stage(docs.select(*keys(host), F.col("text")).mapInArrow(measure, HASHES), "line-hashes")


def lines_to_go(docs: DataFrame, host: str, most: int) -> DataFrame:
    """Columns r_id, r_th, r_host, gone: hashes of the lines that a document loses, stored."""
    lines = line_hashes(docs, host).select("doc_id", "th", "host", F.explode("lines").alias("line"))
    # counts arrive pre-aggregated; a host's many lines spread over all tasks
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("held"), F.min("doc_id").alias("first"))
    frequent = counted.filter(F.col("held") > most).select(
        F.col("host").alias("f_host"), F.col("line").alias("f_line"), "first")
    gone = (lines.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
            .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
            .groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), F.col("host").alias("r_host"))
            .agg(F.collect_set("line").alias("gone")))  # bounded by the document
    return stage(gone, "frequent-lines")


def measured(text: Column, gone: Column) -> Column:
    """Struct of the figures of a text and, if it loses lines, what is left of it."""
    @F.arrow_udf(MADE)
    def measure(texts: pa.Array, losses: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(7)]
        for scalar, loss in zip(texts, losses):
            whole, lost, rest, left = scalar.as_py() or b"", loss.as_py(), None, 0
            words = whole.split()
            lines = whole.split(b"\n")
            if lost:
                out_of = set(lost)
                rest = b"\n".join(x for x in lines if line_hash(x) not in out_of)
                left = len(rest.split())
            filled = [x for x in lines if x and not x.isspace()]
            together = b"".join(words)
            for column, value in zip(out, (
                    len(words), len(together.decode("utf-8", "replace")), sum(whole.count(s) for s in SYMBOLS),
                    len(filled) - len(set(filled)), repeat_words(words), len(words) - left if lost else 0, rest)):
                column.append(value)
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(out, [pa.int64()] * 6 + [pa.binary()])], [*FIGURES, "rest"])

    return measure.asNondeterministic()(text, gone)  # else a filter above would run it once more


def clean(docs: DataFrame, host: str = "source", most: int = 10, min_words: int = 20, max_repeat_percent: int = 30,
          left_words: int = 20, left_share: float = 0.5) -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``, and figures and verdict (n_words ... base_failed, kept).

    ``n_line_words`` counts the words taken out; the other figures are of the text before. All columns
    are kept; figures replace input columns of their names.
    """
    gone = lines_to_go(docs, host, most)
    rows = docs.select(F.struct("*").alias("doc"), F.struct(*keys(host)).alias("key"))
    same = [F.col(f"key.{a}").eqNullSafe(F.col(b)) for a, b in (("doc_id", "r_id"), ("th", "r_th"), ("host", "r_host"))]
    made = rows.join(small_or_not(gone), same[0] & same[1] & same[2], "left").select(
        "doc", measured(F.col("doc.text").cast("binary"), F.col("gone")).alias("made"))
    n_words, taken = F.col("made.n_words"), F.col("made.n_line_words")
    left = n_words - taken
    failed = (n_words < min_words) | (F.col("made.n_repeat_words") * 100 > n_words * max_repeat_percent)
    depleted = (taken > 0) & ((left < left_words) | (left < n_words * left_share))
    columns = [F.coalesce(F.col("made.rest").cast("string"), F.col("doc.text")).alias("text") if name == "text"
               else F.col(f"doc.`{name}`").alias(name)
               for name in docs.columns if name not in (*FIGURES, "base_failed", "kept")]
    return made.select(*columns, *[f"made.{name}" for name in FIGURES], failed.alias("base_failed"),
                       (~failed & ~depleted).alias("kept"))


def judge(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """Figures and verdict per document, without the texts: columns doc_id, n_words ... base_failed, kept."""
    texts = base_columns(docs, doc_id="doc_id", text="text", host=host)
    return clean(texts, "host", **limits).select(
        F.col("doc_id").cast("long").alias("doc_id"), *FIGURES, "base_failed", "kept")
