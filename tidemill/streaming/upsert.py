"""A catalog table kept up to date from a stream of changes, in a bounded number of files.

The table is a set of runs, each with one row per id, in order of the ids. A micro-batch adds a run on level 0. When
a level has ``FANOUT`` runs, they are merged into one on the next level, so a change is written again once
per level, and the runs grow in number with the logarithm of the batches.

Which runs count is said by the newest file of the folder ``manifest``, and by nothing else: a run counts from the
moment the manifest that names it is there. A batch or a merge that fails before that changes nothing, and what it
wrote is deleted by a later one. The manifest also says which batch of which stream was the last, so a batch that is run
again after that moment is not added twice. There has to be one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.operators.catalog import latest
from tidemill.sources import shared_files
from tidemill.streaming.runs import run_batches

FANOUT = 4
#: Manifests that stay, with the runs they name, for readers that have begun.
KEPT_VERSIONS = 3


@dataclass
class Manifest:
    version: int = 0
    runs: list[tuple[str, int]] = field(default_factory=list)  # name and level
    last_batch: dict[str, int] = field(default_factory=dict)  # by the stream's checkpoint


class ChangeTable:
    """The table below a folder; ``id_col`` may be null, ``seq_col`` says which change of an id is the newest."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, seq_col: str):
        self.spark, self.folder, self.id_col, self.seq_col = spark, folder.rstrip("/"), id_col, seq_col

    def versions(self) -> list[int]:
        found = shared_files.names(self.spark, f"{self.folder}/manifest")
        return [int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or an empty one."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Manifest()
        stored = json.loads(shared_files.read_text(self.spark, f"{self.folder}/manifest/{version:012d}.json"))
        return Manifest(stored["version"], [tuple(r) for r in stored["runs"]], stored["last_batch"])

    def swap(self, manifest: Manifest) -> None:
        """From here on the manifest counts."""
        shared_files.create_text(
            self.spark, f"{self.folder}/manifest/{manifest.version:012d}.json", json.dumps(asdict(manifest)))

    def paths(self, runs: list[tuple[str, int]]) -> list[str]:
        return [f"{self.folder}/runs/{name}" for name, _ in runs]

    def write_run(self, rows: DataFrame) -> str:
        """One row per id, in files of the size that adaptive execution aims for."""
        name = uuid.uuid4().hex
        newest = latest(rows, [self.id_col], self.seq_col).hint("rebalance", F.col(self.id_col))
        newest.sortWithinPartitions(self.id_col).write.parquet(f"{self.folder}/runs/{name}")
        return name

    def add(self, changes: DataFrame, stream: str, batch_id: int) -> None:
        """Add a batch of changes once, then merge full levels."""
        now = self.manifest()
        if batch_id > now.last_batch.get(stream, -1):
            run = self.write_run(changes)
            now = Manifest(now.version + 1, [*now.runs, (run, 0)], {**now.last_batch, stream: batch_id})
            self.swap(now)
        self.merge(now, changes.schema)
        self.clean()

    def merge(self, now: Manifest, schema: StructType) -> None:
        level = 0
        while any(at >= level for _, at in now.runs):
            own = [r for r in now.runs if r[1] == level]
            if len(own) >= FANOUT:
                run = self.write_run(self.spark.read.schema(schema).parquet(*self.paths(own)))
                now = Manifest(now.version + 1, [r for r in now.runs if r not in own] + [(run, level + 1)], now.last_batch)
                self.swap(now)
            level += 1

    def clean(self) -> None:
        """Delete old manifests and the runs that none of the others names."""
        versions = self.versions()
        kept = versions[-KEPT_VERSIONS:]
        named = {name for v in kept for name, _ in self.manifest(v).runs}
        for version in versions[:-KEPT_VERSIONS]:
            shared_files.delete(self.spark, f"{self.folder}/manifest/{version:012d}.json")
        for name in shared_files.names(self.spark, f"{self.folder}/runs"):
            if name not in named:
                shared_files.delete(self.spark, f"{self.folder}/runs/{name}")

    def read(self, schema: StructType) -> DataFrame:
        """The table as of the newest manifest."""
        paths = self.paths(self.manifest().runs)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return latest(self.spark.read.schema(schema).parquet(*paths), [self.id_col], self.seq_col)


def stream_upsert(
    stream: DataFrame, target: str, checkpoint: str, id_col: str, seq_col: str
) -> None:
    """Add the changes of a stream to the table below ``target``, each of them once."""
    table = ChangeTable(stream.sparkSession, target, id_col, seq_col)
    run_batches(stream, lambda changes, batch_id: table.add(changes, checkpoint, batch_id), checkpoint)


def current(
    spark: SparkSession, target: str, schema: StructType, id_col: str, seq_col: str
) -> DataFrame:
    """The table as of the last batch."""
    return ChangeTable(spark, target, id_col, seq_col).read(schema)
