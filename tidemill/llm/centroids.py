"""Clustering of integer vectors around centroids, with the equal-average equal-variance search.

Centroids are kept sorted by the mean of their components. A vector is compared outward from its
own mean, to both sides. With ``d`` components, means m and deviations v (the root of the summed squares of
what a component differs from the mean), the squared distance is at least d * (m1 - m2)^2 +
(v1 - v2)^2. So a side ends where the first part alone exceeds the best distance so far, and a centroid
is passed over where both parts do. What is left is decided by the exact distance in 64-bit integers.
The bounds are taken in doubles and loosened by more than their rounding, so no centroid that could win
or tie is passed over.

The vectors are turned into integers once and stored. In each round a task sends one row per cluster and
component, summed; the sums of all tasks, clusters times components, go to the driver, which divides them
exactly.

Cases: vectors that are null or not of ``dims`` components, or hold a component that is null, not finite, or
whose integer reaches 2^27 (131,072 at the usual scale; its squares would not fit 64 bits), take no part. A null vec_id takes part
under the hash of an empty id. Rows are vectors of their own, equal or not; those with equal hashes start
in the order of their components. With fewer vectors than clusters there are as many clusters as vectors. No rows
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.rows import base_columns
from tidemill.session import stage

#: Integer components stay below it, so that the squared differences of 64 of them fit 64 bits.
MOST = 1 << 27
#: Share of the squared lengths by which bounds are loosened.
SLACK = 1e-9
BATCH = 8192


class SortedCentroids:
    """Exact nearest centroid, ties to the smaller number; ``compared`` counts the distances computed."""

    def __init__(self, centroids: np.ndarray):
        self.number = np.argsort(centroids.sum(axis=1), kind="stable")
        self.vectors = centroids[self.number]
        self.sums, self.deviations, squares = self._moments(self.vectors)
        self.longest = float(squares.max())
        self.compared = 0

    @staticmethod
    def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = x.sum(axis=1).astype(float)
        centred = x - sums[:, None] / x.shape[1]
        return sums, np.sqrt((centred * centred).sum(axis=1)), (x.astype(float) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances for the rows of ``x``."""
        n, d, k = len(x), x.shape[1], len(self.vectors)
        sums, deviations, squares = self._moments(x)
        slack = SLACK * (squares + self.longest) + 1
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.full(n, k, np.int64)
        open_ = np.arange(n)
        while len(open_):
            lo, hi = below[open_], above[open_]
            down = np.where(lo >= 0, sums[open_] - self.sums[np.maximum(lo, 0)], np.inf)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[open_], np.inf)
            lower = down <= up
            by_mean = np.minimum(down, up) ** 2 / d
            most = best[open_] + slack[open_]
            going = by_mean <= most  # else all further ones differ even more
            open_, lower, by_mean, most = open_[going], lower[going], by_mean[going], most[going]
            at = np.where(lower, lo[going], hi[going])
            below[open_[lower]] -= 1
            above[open_[~lower]] += 1
            close = by_mean + (deviations[open_] - self.deviations[at]) ** 2 <= most
            rows, at = open_[close], at[close]
            apart = x[rows] - self.vectors[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            number = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = distance[better], number[better]
            self.compared += len(rows)
        return who, best


def as_integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Columns vec_id, v (integers), stored."""
    x = F.col("x").cast("array<double>")
    usable = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(F.abs(c) < MOST / scale, F.lit(False)))
    read = base_columns(vectors, vec_id="vec_id", x="embedding").filter(F.col("x").isNotNull()).filter(usable)
    return stage(read.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v")), "vectors")


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch.slice(at, BATCH)
            yield part, part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """For each cluster that has vectors, the sum of each component, and at -1 their number."""
    k, dims = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SortedCentroids(centroids)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in blocks(batches, dims):
            who, _ = index.nearest(x)
            order = np.argsort(who, kind="stable")
            found, begins = np.unique(who[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], begins, axis=0)
            counts += np.bincount(who, minlength=k)
        held = np.flatnonzero(counts)
        table = np.concatenate([counts[held, None], sums[held]], axis=1)
        yield pa.record_batch([
            pa.array(np.repeat(held, dims + 1).astype(np.int32)),
            pa.array(np.tile(np.arange(-1, dims), len(held)).astype(np.int32)), pa.array(table.ravel())],
            names=["cluster", "place", "total"])

    parts = vectors.mapInArrow(assign, "cluster int, place int, total long")
    out: dict[int, dict[int, int]] = {}
    for cluster, place, total in parts.groupBy("cluster", "place").agg(
            F.sum(F.col("total").cast("decimal(38,0)"))).collect():  # clusters times components
        out.setdefault(cluster, {})[place] = int(total)
    return out


ASSIGNED = "vec_id long, cluster int, distance long"


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64,
            scale: int = 1024) -> DataFrame:
    """Columns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per vector."""
    spark = vectors.sparkSession
    held = as_integers(vectors, dims, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = held.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame(
            [], ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        for number, sums in cluster_sums(held, centroids).items():
            centroids[number] = [sums[i] // sums[-1] for i in range(dims)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SortedCentroids(centroids)
        for part, x in blocks(batches, dims):
            who, distance = index.nearest(x)
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(who.astype(np.int32)),
                                   pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = stage(held.mapInArrow(assign, ASSIGNED), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row per cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame(
        [(i, inertia.get(i, 0), sum(inertia.values()), s) for i, s in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select(  # a row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
