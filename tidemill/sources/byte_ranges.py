"""Text files as lines with their places, read by ranges of bytes, in batch and as a stream.

Files are cut into ranges of ``range_bytes``; a task reads one of that size, or many short ones. A line belongs to the range that holds its
line end, so a reader looks back from the start of its range for the start of the first line, and every line comes
exactly once wherever the cuts are. The stream's offset is a size per file: lines come once their
line end has been written, and a restart goes on at the byte where the last batch ended.

Places count bytes and line ends are single line feeds. A file that ends in .gz is one range, and its places
are those of the unpacked text; a stream cannot follow it. Files are opened through pyarrow, which knows local paths and
file, hdfs, s3 (also written s3a), gs and abfs URIs.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemill.plans.order import ID_SHIFTS
from tidemill.plans.segments import by_shift, running_sum
from tidemill.session import stage

FORMAT = "byte_ranges"
RANGE_BYTES = 64 << 20
#: Ranges get longer where there would be more, so that a row for each can be broadcast.
MOST_RANGES = 1 << 20
BLOCK = 4 << 20
LOOK_BACK = 64 << 10
#: A task reads ranges of up to ``TASK_BYTES`` together, or one that is longer; to open one counts as ``OPEN_BYTES``.
TASK_BYTES = 16 << 20
OPEN_BYTES = 16 << 10
#: Lines of short ranges are handed on together, about so many.
BATCH_LINES = 4096

LINES = "file string, range_no bigint, line_in_range bigint, start_byte bigint, end_byte bigint, value string"
COUNTS = "file string, low bigint, range_no bigint, n_lines bigint"
SIZES = "file string, file_bytes bigint"


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what to put before such paths to find them again."""
    if path.startswith("s3a://"):
        path = "s3" + path[3:]
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        return fs.LocalFileSystem(), posixpath.abspath(path), ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, "" if isinstance(system, fs.LocalFileSystem) else path[:path.index("://") + 3]


@dataclass(frozen=True)
class File:
    uri: str
    size: int


def list_files(path: str, pattern: str = "*") -> list[File]:
    """The files below a folder, or the one file, in the order of their paths; hidden ones are left out."""
    system, inside, prefix = located(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [File(prefix + info.path, info.size)]
    found = []
    for entry in system.get_file_info(fs.FileSelector(inside, recursive=True)):
        parts = entry.path[len(inside):].strip("/").split("/")
        if entry.type == fs.FileType.File and not any(p[:1] in "._" for p in parts) and fnmatch.fnmatch(parts[-1], pattern):
            found.append(File(prefix + entry.path, entry.size))
    return sorted(found, key=lambda f: f.uri)


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file. Reading begins at ``begin`` at the earliest; ``last``: the file ends here."""

    file: str
    number: int
    low: int
    high: int
    begin: int
    last: bool
    packed: bool = False


def cut(files: Sequence[File], range_bytes: int, begin: int = 0) -> list[Range]:
    """Ranges of whole files, numbered in order; those that end before ``begin`` are left out, but keep their numbers."""
    range_bytes = max(range_bytes, -(-sum(f.size for f in files) // MOST_RANGES))
    out, number = [], 0
    for file in files:
        packed = file.uri.endswith(".gz")
        step = max(1, file.size) if packed else range_bytes
        for low in range(0, file.size, step):
            high = min(file.size, low + step)
            if packed or high > begin:
                out.append(Range(file.uri, number, low, high, begin, high == file.size, packed))
            number += 1
    return out


@dataclass(frozen=True)
class Task(InputPartition):
    """Ranges that one task reads, in order."""

    ranges: tuple[Range, ...]


def tasks(ranges: Sequence[Range]) -> list[Task]:
    """Consecutive ranges together, so that there are not more tasks than the bytes ask for; one empty task if none."""
    out: list[list[Range]] = [[]]
    held = 0
    for part in ranges:
        size = part.high - part.low + OPEN_BYTES
        if out[-1] and held + size > TASK_BYTES:
            out.append([])
            held = 0
        out[-1].append(part)
        held += size
    return [Task(tuple(t)) for t in out]


def blocks(part: Range) -> Iterator[bytes]:
    """The bytes of a range, or all of a packed file."""
    system, path, _ = located(part.file)
    if part.packed:
        with system.open_input_stream(path, compression="gzip") as stream:
            while block := stream.read(BLOCK):
                yield block
        return
    with system.open_input_file(path) as file:
        at = part.low
        while at < part.high and (block := file.read_at(min(BLOCK, part.high - at), at)):
            yield block
            at += len(block)


def line_head(part: Range) -> bytes:
    """What the first line of a range has before it, no further than ``begin``."""
    system, path, _ = located(part.file)
    pieces, at, step = [], part.low, LOOK_BACK
    with system.open_input_file(path) as file:
        while at > part.begin:
            size = min(step, at - part.begin)
            block = file.read_at(size, at - size)
            found = block.rfind(b"\n")
            pieces.append(block[found + 1:])
            if found >= 0:
                break
            at, step = at - size, step * 2
    return b"".join(reversed(pieces))


def count_lines(part: Range) -> int:
    lines, end = 0, b"\n"
    for block in blocks(part):
        lines, end = lines + block.count(b"\n"), block[-1:]
    return lines + (part.last and end != b"\n")


def whole_character(text: bytes) -> int:
    """How many bytes a text begins with that belong to a character before it, three at most."""
    skip = 0
    while skip < min(3, len(text)) and text[skip] & 0xC0 == 0x80:
        skip += 1
    return skip


def as_strings(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def read_lines(part: Range, unfinished: bool) -> Iterator[pa.RecordBatch]:
    """Lines whose end lies in the range; with ``unfinished`` also what the file ends with behind its last line end."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in LINES.split(", ")]
    ranged, skipped = part, 0
    if part.low < part.begin and not part.packed:  # reading starts inside
        ranged = Range(part.file, part.number, part.begin, part.high, part.begin, part.last)
        skipped = count_lines(Range(part.file, part.number, part.low, part.begin, 0, False))
    held: list[bytes] = []
    at, line, first = 0 if part.packed else ranged.low, skipped, True

    def batch(lines: list[bytes], ends: int) -> pa.RecordBatch:
        nonlocal at, line, first
        if first and not part.packed:
            head = line_head(ranged)
            lines[0], at = head + lines[0], at - len(head)
            if at == part.begin > 0:
                cut_off = whole_character(lines[0])
                lines[0], at = lines[0][cut_off:], at + cut_off
        first = False
        starts = []
        for value in lines:
            starts.append(at)
            at += len(value) + ends
        stops = [*starts[1:], at]
        n = len(lines)
        columns = ([part.file] * n, [part.number] * n, list(range(line, line + n)), starts, stops)
        line += n
        return pa.record_batch([*(pa.array(c, k) for c, k in zip(columns, kinds)), as_strings(lines)], names=names)

    for block in blocks(ranged):
        pieces = block.split(b"\n")
        held.append(pieces[0])
        if len(pieces) > 1:
            yield batch([b"".join(held), *pieces[1:-1]], 1)
            held = [pieces[-1]]
    if unfinished and part.last:
        rest = b"".join(held)
        if rest or first and not part.packed and line_head(ranged):
            yield batch([rest], 0)


def read_task(task: Task, unfinished: bool) -> Iterator[pa.RecordBatch]:
    """The lines of all ranges of a task; those of short ranges come together in a batch."""
    held: list[pa.RecordBatch] = []
    lines = size = 0
    for part in task.ranges:
        for batch in read_lines(part, unfinished):
            held.append(batch)
            lines, size = lines + batch.num_rows, size + batch.nbytes
            if lines >= BATCH_LINES or size >= BLOCK:
                yield pa.concat_batches(held)
                held, lines, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


class LinesReader(DataSourceReader):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges

    def partitions(self) -> Sequence[Task]:
        return tasks(self.ranges)

    def read(self, part: Task) -> Iterator[pa.RecordBatch]:
        yield from read_task(part, unfinished=True)


class CountsReader(LinesReader):
    def read(self, part: Task) -> Iterator[tuple]:
        for one in part.ranges:
            yield one.file, one.low, one.number, count_lines(one)


class SizesReader(DataSourceReader):
    def __init__(self, files: list[File]):
        self.files = files

    def read(self, part: InputPartition | None) -> Iterator[tuple]:
        for file in self.files:
            yield file.uri, file.size


class GrowingFiles(DataSourceStreamReader):
    """The offset is the size of each file. A file that gets shorter than what was read of it is an error."""

    def __init__(self, path: str, pattern: str, range_bytes: int):
        self.path, self.pattern, self.range_bytes = path, pattern, range_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        try:
            files = list_files(self.path, self.pattern)
        except FileNotFoundError:
            return {}
        return {f.uri: f.size for f in files if not f.uri.endswith(".gz")}

    def partitions(self, start: dict, end: dict) -> Sequence[Task]:
        out = []
        for uri in sorted(end):
            low, high = start.get(uri, 0), end[uri]
            if high < low:
                raise ValueError(f"{uri} has {high} bytes, and {low} were read before")
            out += [Range(uri, 0, at, min(high, at + self.range_bytes), 0, False)
                    for at in range(low, high, self.range_bytes)]
        return tasks(out)

    def read(self, part: Task) -> Iterator[pa.RecordBatch]:
        yield from read_task(part, unfinished=False)


class ByteRanges(DataSource):
    """Options: path, pattern (of file names), rangeBytes, startByte, and what: lines, counts or sizes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return {"lines": LINES, "counts": COUNTS, "sizes": SIZES}[self.options.get("what", "lines")]

    def _of(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def reader(self, schema) -> DataSourceReader:
        files = list_files(self.options["path"], self.options.get("pattern", "*"))
        what = self.options.get("what", "lines")
        if what == "sizes":
            return SizesReader(files)
        if what == "counts":
            return CountsReader(cut(files, self._of("rangebytes", RANGE_BYTES)))
        return LinesReader(cut(files, self._of("rangebytes", RANGE_BYTES), self._of("startbyte", 0)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingFiles(self.options["path"], self.options.get("pattern", "*"), self._of("rangebytes", RANGE_BYTES))


def _read(spark: SparkSession, what: str, path: str, pattern: str, range_bytes: int, start_byte: int = 0) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return (spark.read.format(FORMAT).option("what", what).option("pattern", pattern).option("rangeBytes", range_bytes)
            .option("startByte", start_byte).load(path))


def read_numbered(spark: SparkSession, path: str, pattern: str = "*", start_byte: int = 0,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Columns file, row_id, line_no, start_byte, end_byte, value: every line of the files.

    ``line_no`` counts the lines of the file and ``row_id`` those of all files, in the order of their paths, both
    from 0. They do not depend on the ranges. Line ends are counted first, in a pass that sends one row per
    range; these are summed up in levels and come to the lines by a broadcast of at most ``MOST_RANGES`` rows.

    With ``start_byte`` only what lies from there on is read. A line cut by it comes from there on, or from the next
    character if the place lies within one.
    """
    counts = stage(_read(spark, "counts", path, pattern, range_bytes), "line-counts")
    before = running_sum(
        counts, F.col("n_lines"), "upto", order=["range_no"], levels=by_shift("range_no", *ID_SHIFTS)
    ).select("file", "low", "range_no", (F.col("upto") - F.col("n_lines")).alias("__before"))
    first = before.where("low = 0").select("file", F.col("__before").alias("__first"))
    ranges = before.join(first, "file").select("range_no", "__before", "__first")
    lines = _read(spark, "lines", path, pattern, range_bytes, start_byte)
    row_id = F.col("__before") + F.col("line_in_range")
    return lines.join(F.broadcast(ranges), "range_no").select(
        "file", row_id.alias("row_id"), (row_id - F.col("__first")).alias("line_no"), "start_byte", "end_byte", "value")


def files_out_of_range(spark: SparkSession, path: str, start_byte: int, pattern: str = "*") -> DataFrame:
    """Files that end at or before a read position, with their sizes."""
    return _read(spark, "sizes", path, pattern, RANGE_BYTES).where(F.col("file_bytes") <= start_byte)


def stream_lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Columns file, start_byte, end_byte, value: lines of files that grow, each once its line end is there."""
    spark.dataSource.register(ByteRanges)
    return (spark.readStream.format(FORMAT).option("pattern", pattern).option("rangeBytes", range_bytes).load(path)
            .select("file", "start_byte", "end_byte", "value"))


def write_lines(lines: DataFrame, folder: str, file: str = "file", order: str = "line_no", value: str = "value") -> None:
    """One file per value of ``file`` below ``folder``, with its lines in order.

    A file is written beside its place and then moved there, so readers see the old one or the new one whole, and a
    task that runs again writes the same. One file is one task's work, as it has to be written from its start to its end.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = located(folder)
        system.create_dir(root, recursive=True)
        name, sink, beside, written = None, None, "", 0

        def close() -> None:
            if sink is not None:
                sink.close()
                system.move(beside, posixpath.join(root, name))

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != name:
                    close()
                    name, beside = own, posixpath.join(root, f".{own}-{uuid.uuid4().hex}")
                    sink, written = system.open_output_stream(beside), written + 1
                sink.write((text + "\n").encode())
        close()
        yield pa.record_batch([pa.array([written], pa.int64())], names=["files"])

    ordered = lines.select(F.col(file).cast("string").alias("file"), F.col(value).alias("value"), F.col(order).alias("at"))
    (ordered.repartition("file").sortWithinPartitions("file", "at").select("file", "value")
     .mapInArrow(write, "files bigint").agg(F.sum("files")).collect())
