"""Token ids as Arrow stream files of equal-length sequences with masks, and reading them back.

A file holds record batches of two columns, ``ids`` and ``mask``, both fixed-size lists of
``length`` values: the ids of its documents one after another, each followed by the end id, the
last sequence filled up with zeros under a false mask. All batches but the last have
``BATCH_SEQUENCES`` rows, so sequence *k* of a file is row ``k % BATCH_SEQUENCES`` of batch
``k // BATCH_SEQUENCES``; a memory-mapped file gives it without copying. An index table names, for
each document, the file and the place of its first id there.

Cases: null and empty texts are one end id. Rows with equal doc_id follow each other in the order
of their texts. No rows give no file and an empty index. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.rows import base_columns, slices
from tidemill.llm.tokens import encoder
from tidemill.session import scratch_dir, stage

BATCH_SEQUENCES = 64
INDEX = "doc_id long, part int, file string, part_start long, n_tokens long"


class SequenceFile:
    """Writes one file; ``add`` takes the ids of a document and returns where they begin."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int):
        self.length, self.dtype, self.sink, self.written = length, dtype, sink, 0
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> int:
        start = self.written + self.held_ids
        self.held.append(ids)
        self.held_ids += len(ids)
        full = self.length * BATCH_SEQUENCES
        if self.held_ids >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for i in range(0, whole, full):
                self._write(flat[i:i + full], np.ones(full, bool))
            self.held, self.held_ids = [flat[whole:].copy()], len(flat) - whole
        return start

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.written += len(ids)

    def close(self) -> None:
        if self.held_ids:
            flat = np.concatenate(self.held)
            padded = -(-len(flat) // self.length) * self.length
            ids = np.zeros(padded, self.dtype)
            ids[:len(flat)] = flat
            self._write(ids, np.arange(padded) < len(flat))
        self.writer.close()
        self.sink.close()


class Sequences:
    """Random access to the ids of one file; local files are memory-mapped."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else pa.py_buffer(
            system.open_input_file(path).read())
        with ipc.open_stream(source) as reader:
            self.batches = [b for b in reader]
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``k``, both without copying."""
        batch, row = self.batches[k // BATCH_SEQUENCES], k % BATCH_SEQUENCES
        return (batch.column(0).slice(row, 1).flatten().to_numpy(),
                batch.column(1).slice(row, 1).flatten())

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file on."""
        per_batch = self.length * BATCH_SEQUENCES
        parts = []
        while n > 0:
            batch, at = divmod(start, per_batch)
            flat = self.batches[batch].column(0).flatten().to_numpy()[at:at + n]
            parts.append(flat)
            start, n = start + len(flat), n - len(flat)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(maxsize=1)
def opened(uri: str) -> Sequences:
    return Sequences(uri)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Write all documents in ascending doc_id order below ``folder``; returns the index, stored.

    Files are in range order of doc_id, so part number and place order all documents. A task that
    runs again writes a file of its own; only files named in the index count.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer), None
        part = TaskContext.get().partitionId()
        for batch, texts in slices(batches):
            if out is None:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
                out = SequenceFile(system.open_output_stream(f"{path}/{name}"), encode.dtype, length)
            end = np.array([end_id], encode.dtype)
            starts, counts = [], []
            for ids in encode.encode(texts):
                tokens = np.concatenate([np.frombuffer(ids, encode.dtype), end])
                starts.append(out.add(tokens))
                counts.append(len(tokens))
            n = len(starts)
            yield pa.record_batch([
                batch.column(0).cast(pa.int64()), pa.array([part] * n, pa.int32()),
                pa.array([f"{folder}/{name}"] * n, pa.string()),
                pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "part", "file", "part_start", "n_tokens"])
        if out is not None:
            out.close()

    ordered = (base_columns(docs, doc_id="doc_id", text="text")
               .repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", "text"))
    return stage(ordered.mapInArrow(write, INDEX), "sequence-index")


def read_sequences(index: DataFrame) -> DataFrame:
    """Per document of the index, from the files: place in the whole output, length, checksum.

    Columns doc_id, start, n_tokens, ids_crc32, file, part_start.
    """
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    # one row per file
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [
                zlib.crc32(opened(file).ids(start, n).astype("<u4").tobytes())
                for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "part_start", "n_tokens")))]
            yield pa.record_batch([*batch.columns, pa.array(crcs, pa.int64())],
                                  names=[*batch.schema.names, "ids_crc32"])

    read_back = (index.repartition("part").sortWithinPartitions("part", "part_start")
                 .mapInArrow(read, INDEX + ", ids_crc32 long"))
    return read_back.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", "file",
        "part_start")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    folder = scratch_dir(docs.sparkSession, "sequences")
    return read_sequences(write_sequences(docs, folder, tokenizer, end_id, length))
