"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Centroids are fitted on a bounded sample with a k-means that charges for full clusters; there is one
for about ``LIST_VECTORS`` vectors, at most ``MOST_LISTS``. A vector is entered into the list of its
nearest centroid, and near a boundary into those of further ones: up to ``COPIES``, while their
distance is within ``closure`` times the least and no list already chosen is much nearer to the
candidate than the vector is (``SPREAD`` of the squared distance). Centroids are found by a best-first search in a graph of near
centroids held in memory; so are the lists of a query, of which those are read whose distance is
within ``ratio`` times the least. Every vector is indexed.

How far lists must be read depends on the rows. So the nearest of ``TRIALS`` queries are found by brute force as well,
and every query reads at least as many lists as these need for a recall of ``RECALL``; if that is more than half of
the lists, it reads them all, and of each vector only the entry in its nearest list.

A query first reads its nearest ``FIRST_LISTS`` lists. The ``k``-th best score found there is a bound: of
the further lists only rows that reach it leave the search, so what is shuffled grows with the queries
and not with the lists they read, and the answer is the same.

Inner products become distances by one more coordinate, which brings all vectors to the length of
the longest one; queries are brought to that length.

Lists are cut into chunks of bounded size, and the queries that read a list into blocks; a task joins
one block with one chunk. Products are summed in double precision in the order of the
coordinates, so equal vectors get equal scores wherever they are.

Cases: vectors that are null, zero, hold null or non-finite components, or are not of the most
common length (the shorter on a tie) take no part; nor does a null id. Rows with equal ids are found
once. With fewer than ``k`` other vectors all are found. No rows give no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemill.session import stage

#: Centroids are fitted on about so many vectors.
SAMPLE = 20_000
LIST_VECTORS = 128
MOST_LISTS = 4096
COPIES = 4
CLOSURE = 1.1
SPREAD = 0.2
RATIO = 1.24
#: Nodes a search of the centroid graph keeps: for a query this share of all, and at least so many.
BEAM_SHARE = 3
BEAM = 96
GRAPH_LINKS = 24
CHUNK = 4096
#: Queries that are also answered by brute force, and the share of their nearest that the lists have to hold.
TRIALS = 256
RECALL = 0.97
#: Lists that a query reads first, for a bound on what the others have to give.
FIRST_LISTS = 4
ROUNDS = 10
BATCH = 512


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Balanced k-means: a cluster costs more the fuller it was in the last round."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    charge = np.zeros(lists, np.float32)
    spread = float(sample.var(axis=0).sum())
    for _ in range(ROUNDS):
        nearest = np.concatenate([
            (((centroids ** 2).sum(1) + charge)[None, :] - 2 * part @ centroids.T).argmin(1)
            for part in np.array_split(sample, max(1, len(sample) // BATCH))])
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        if (~filled).any():
            centroids[~filled] = sample[rng.choice(len(sample), int((~filled).sum()))]
        charge = (0.1 * spread * (counts / max(1.0, counts.mean()) - 1)).astype(np.float32)
    return centroids.astype(np.float32)


class CentroidGraph:
    """Centroids, each linked with its nearest ones and a few others, searched best first."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        n = len(centroids)
        rng = np.random.default_rng(seed)
        self.centroids = centroids
        self.squares = (centroids ** 2).sum(1)
        near = min(GRAPH_LINKS, n)
        links = [np.argpartition(self.distances(centroids[i:i + 1], np.arange(n))[0], near - 1)[:near]
                 for i in range(n)]
        far = rng.integers(0, n, (n, 4))
        self.links = np.concatenate([np.stack(links), far], axis=1).astype(np.int32)
        self.entries = rng.choice(n, min(n, 16), replace=False)

    def distances(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of every point to ``nodes``."""
        return np.maximum(0, (points ** 2).sum(1)[:, None] + self.squares[nodes] - 2 * points @ self.centroids[nodes].T)

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of each point found, nearest first, with squared distances (inf where none)."""
        m, n = len(points), len(self.centroids)
        beam = min(beam, n)
        rows = np.arange(m)[:, None]
        own = (points ** 2).sum(1)
        seen = np.zeros((m, n), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries.astype(np.int32), (m, 1))
        dist = self.distances(points, self.entries)
        open_ = np.ones_like(dist, bool)
        while True:
            best = np.where(open_, dist, np.inf).argmin(1)
            active = np.flatnonzero(open_[np.arange(m), best])
            if not len(active):
                break
            open_[active, best[active]] = False
            fresh = self.links[ids[active, best[active]]]
            new = ~seen[active[:, None], fresh]
            # a node linked twice counts once
            order = np.argsort(fresh, axis=1, kind="stable")
            sorted_ = np.take_along_axis(fresh, order, 1)
            twice = np.zeros_like(new)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            new &= ~twice
            seen[active[:, None], fresh] = True
            d = own[active, None] + self.squares[fresh] - 2 * np.einsum(
                "ijk,ik->ij", self.centroids[fresh], points[active])
            more_d = np.full((m, fresh.shape[1]), np.inf, dist.dtype)
            more_i = np.zeros((m, fresh.shape[1]), np.int32)
            more_d[active], more_i[active] = np.where(new, np.maximum(0, d), np.inf), fresh
            dist, ids = np.concatenate([dist, more_d], 1), np.concatenate([ids, more_i], 1)
            open_ = np.concatenate([open_, np.isfinite(more_d)], 1)
            if dist.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
                dist, ids, open_ = dist[rows, keep], ids[rows, keep], open_[rows, keep]
        order = np.argsort(dist, 1, kind="stable")
        return ids[rows, order], dist[rows, order]


    def ranked(self, points: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
        """Like ``search``, for queries; beyond its beam all centroids are compared, so ``lists`` are always found."""
        n = len(self.centroids)
        beam = max(BEAM, n // BEAM_SHARE)
        if lists <= beam:
            return self.search(points, beam)
        dist = self.distances(points, np.arange(n))
        ids = np.argsort(dist, 1, kind="stable").astype(np.int32)
        return ids, np.take_along_axis(dist, ids, 1)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Indexed vectors with the coordinate that brings them to the length of the longest."""
    rest = np.sqrt(np.maximum(0, longest ** 2 - (vectors.astype(np.float64) ** 2).sum(1)))
    return np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)


def scaled(queries: np.ndarray, longest: float) -> np.ndarray:
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    return np.concatenate([queries * (longest / norms)[:, None], np.zeros((len(queries), 1))], 1).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (vec_id, vector) that take part, and the length of their vectors."""
    good = rows.filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    dim = common["size"] if common else 0
    return good.filter(F.size("vector") == dim), dim


def in_lists(rows: DataFrame, graph, longest: float, closure: float, copies: int) -> DataFrame:
    """A row per vector and list it is entered into; ``nearest`` marks the first."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: CentroidGraph = graph.value
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                points = lengthened(matrix(batch.column(1)), longest)
                ids, dist = known.search(points, 32)
                limit = dist[:, :1] * closure ** 2
                owners, lists, first = [np.arange(len(points))], [ids[:, 0]], [np.ones(len(points), bool)]
                chosen = [[i] for i in ids[:, 0].tolist()]
                for k in range(1, ids.shape[1]):
                    for row in np.flatnonzero(dist[:, k] <= limit[:, 0]).tolist():
                        mine, candidate = chosen[row], int(ids[row, k])
                        if len(mine) < copies and (
                                ((known.centroids[mine] - known.centroids[candidate]) ** 2).sum(1)
                                > SPREAD * dist[row, k]).all():
                            mine.append(candidate)
                extra = [(row, c) for row, mine in enumerate(chosen) for c in mine[1:]]
                if extra:
                    more = np.array(extra)
                    owners.append(more[:, 0]), lists.append(more[:, 1]), first.append(np.zeros(len(more), bool))
                yield pa.record_batch([
                    *[c.take(pa.array(np.concatenate(owners))) for c in batch.columns],
                    pa.array(np.concatenate(lists), pa.int32()), pa.array(np.concatenate(first))],
                    names=["vec_id", "vector", "list", "nearest"])

    return rows.mapInArrow(assign, f"vec_id long, vector {kind_of(rows)}, list int, nearest boolean")


def kind_of(rows: DataFrame) -> str:
    return rows.schema["vector"].dataType.simpleString()


def lists_within(dist: np.ndarray, ids: np.ndarray, held: np.ndarray, ratio: float, k: int) -> tuple[int, int]:
    """How many of a query's lists, nearest first, are within the ratio, and how many hold ``k`` other vectors."""
    found = np.isfinite(dist)
    enough = np.cumsum(held[ids[found]]) >= k + 1
    least = int(enough.argmax()) + 1 if enough.any() else len(held)
    return int((dist[found] <= dist[0] * ratio ** 2).sum()), least


def best_of_all(rows: DataFrame, ids: np.ndarray, points: np.ndarray, k: int) -> DataFrame:
    """Columns query_id, vec_id, score: the best ``k`` of all rows for a few queries, by brute force."""
    asked = rows.sparkSession.sparkContext.broadcast((ids, points.astype(np.float64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, queries = asked.value
        best_ids = np.zeros((len(asking), 0), np.int64)
        best = np.zeros((len(asking), 0))
        for whole in batches:
            for begin in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(begin, CHUNK)
                own = batch.column(0).to_numpy(zero_copy_only=False)
                scores = queries @ matrix(batch.column(1)).astype(np.float64).T
                scores[asking[:, None] == own[None, :]] = -np.inf
                best = np.concatenate([best, scores], 1)
                best_ids = np.concatenate([best_ids, np.broadcast_to(own, scores.shape)], 1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, 1)[:, :k]
                    best, best_ids = np.take_along_axis(best, top, 1), np.take_along_axis(best_ids, top, 1)
        places = np.isfinite(best)
        yield pa.record_batch([pa.array(np.broadcast_to(asking[:, None], best.shape)[places]),
                               pa.array(best_ids[places]), pa.array(best[places])],
                              names=["query_id", "vec_id", "score"])

    return best_of(rows.mapInArrow(search, "query_id long, vec_id long, score double"), k)


def lists_needed(rows: DataFrame, asking: DataFrame, entered: DataFrame, graph, held: np.ndarray, longest: float,
                 ratio: float, k: int) -> int:
    """How many lists every query has to read at least, so that ``TRIALS`` of them find ``RECALL`` of their nearest."""
    known: CentroidGraph = graph.value
    lists = len(held)
    few = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toArrow()
    if not few.num_rows:
        return 0
    ids = few.column("vec_id").to_numpy()
    points = matrix(few.column("vector").combine_chunks())
    truth = best_of_all(rows, ids, points, k).select("query_id", "vec_id")
    places = entered.join(F.broadcast(truth), "vec_id").groupBy("query_id", "vec_id").agg(
        F.collect_set("list").alias("lists")).toArrow()  # TRIALS * k rows
    asked = scaled(points, longest)
    near, dist = known.ranked(asked, 0)
    every = known.ranked(asked, lists)[0]
    within, rank, far = {}, {}, {}
    for i, query in enumerate(ids.tolist()):
        within[query] = max(lists_within(dist[i], near[i], held, ratio, k))
        rank[query] = np.full(lists, lists)
        rank[query][near[i][np.isfinite(dist[i])]] = np.arange(int(np.isfinite(dist[i]).sum()))
        far[query] = np.argsort(every[i])
    needed = []
    for query, found in zip(places.column("query_id").to_pylist(), places.column("lists").to_pylist()):
        at = int(rank[query][found].min())
        if at < within[query]:
            needed.append(0)
        else:  # what the graph's beam does not hold takes a comparison with all centroids
            needed.append(1 + (at if at < lists else max(near.shape[1], int(far[query][found].min()))))
    needed.sort()
    least = needed[max(0, int(np.ceil(RECALL * len(needed))) - 1)] if needed else 0
    return lists if 2 * least > lists else least


def read_lists(queries: DataFrame, graph, sizes, longest: float, ratio: float, k: int, needed: int = 0) -> DataFrame:
    """A row per query and list it reads: within the ratio, ``needed`` of them, and enough to hold ``k`` other vectors.

    ``first`` marks the nearest lists, ``FIRST_LISTS`` of them or as many as hold ``k`` others.
    """
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: CentroidGraph = graph.value
        held = sizes.value
        everything = np.arange(len(held))
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                ids, dist = known.ranked(scaled(matrix(batch.column(1)), longest), needed)
                owners, lists, first = [], [], []
                for row in range(batch.num_rows):
                    near = ids[row][np.isfinite(dist[row])]
                    within, least = lists_within(dist[row], ids[row], held, ratio, k)
                    n = max(within, least, needed)
                    chosen = near[:n] if n <= len(near) else everything
                    owners.append(np.full(len(chosen), row))
                    lists.append(chosen)
                    first.append(np.arange(len(chosen)) < max(FIRST_LISTS, least))
                take = pa.array(np.concatenate(owners))
                yield pa.record_batch([*[c.take(take) for c in batch.columns],
                                       pa.array(np.concatenate(lists), pa.int32()),
                                       pa.array(np.concatenate(first))],
                                      names=["vec_id", "vector", "list", "first"])

    return queries.mapInArrow(choose, f"vec_id long, vector {kind_of(queries)}, list int, first boolean")


def best_in_block(k: int):
    """The ``k`` best of a chunk for each query of a block, as far as they reach the query's bound."""
    def search(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        chunk = chunk.drop_duplicates("vec_id")
        ids = chunk["vec_id"].to_numpy(np.int64)
        vectors = np.stack(chunk["vector"].to_numpy()).astype(np.float64)
        asked = block["vec_id"].to_numpy(np.int64)
        bounds = block["bound"].to_numpy(np.float64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for begin in range(0, len(asked), 256):
            part = asked[begin:begin + 256]
            queries = np.stack(block["vector"].iloc[begin:begin + 256].to_numpy()).astype(np.float64)
            scores = np.zeros((len(part), len(ids)))
            for d in range(vectors.shape[1]):
                scores += queries[:, d, None] * vectors[None, :, d]
            scores[part[:, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, -k, 1)[:, -k] if len(ids) > k else np.full(len(part), -np.inf)
            least = np.maximum(least, bounds[begin:begin + 256])
            rows, places = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            order = np.lexsort((ids[places], -scores[rows, places], rows))
            rows, places = rows[order], places[order]
            starts = np.searchsorted(rows, np.arange(len(part)))
            top = np.arange(len(rows)) - starts[rows] < k
            found.append((part[rows[top]], ids[places[top]], scores[rows[top], places[top]]))
        return pd.DataFrame({name: np.concatenate([f[i] for f in found])
                             for i, name in enumerate(("query_id", "vec_id", "score"))})
    return search


def parts_of(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def best_in_lists(entered: DataFrame, counts: DataFrame, asked: DataFrame, k: int, chunk: int) -> DataFrame:
    """Columns query_id, vec_id, score: the best of the lists that are ``asked`` (vec_id, vector, list, bound)."""
    parts = (counts.join(asked.groupBy("list").agg(F.count("*").alias("q")), "list")
             .select("list", parts_of(F.col("n"), chunk).alias("chunks"), parts_of(F.col("q"), chunk).alias("blocks")))
    parts = F.broadcast(stage(parts, "list-parts"))  # at most MOST_LISTS rows

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    part_of = lambda count: F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int")
    chunks = entered.join(parts, "list").select(
        "list", part_of("chunks").alias("chunk"), numbers("blocks").alias("block"), "vec_id", "vector")
    blocks = asked.join(parts, "list").select(
        "list", numbers("chunks").alias("chunk"), part_of("blocks").alias("block"), "vec_id", "vector", "bound")
    key = ["list", "chunk", "block"]
    return chunks.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(
        best_in_block(k), "query_id long, vec_id long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            queries: Column | None = None, closure: float = CLOSURE, ratio: float = RATIO, copies: int = COPIES,
            chunk: int = CHUNK) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the ``k`` nearest found of each row that ``queries`` selects.

    ``queries`` is a condition on ``vec_id``; without it all rows are queries.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector].dataType == ArrayType(FloatType(), True) else "array<double>"
    rows, dim = usable(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                                      F.col(f"`{vector}`").cast(kind).alias("vector")))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, longest = facts["n"], float(np.sqrt(facts["square"]))
    share = F.lit(int(min(1.0, SAMPLE / n) * (1 << 30)))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).limit(2 * SAMPLE).select("vector")
    points = matrix(sample.toArrow().column(0).combine_chunks())
    if not len(points):
        points = matrix(rows.limit(1).select("vector").toArrow().column(0).combine_chunks())
    graph = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(
        lengthened(points, longest), max(1, min(MOST_LISTS, n // LIST_VECTORS)))))
    lists = len(graph.value.centroids)

    entered = stage(in_lists(rows, graph, longest, closure, copies), "posting-lists")
    counts = entered.groupBy("list").agg(F.count("*").alias("n"), F.count_if("nearest").alias("own"))
    held = np.zeros(lists, np.int64)
    for r in counts.collect():  # at most MOST_LISTS rows
        held[r["list"]] = r["own"]
    asking = (rows.filter(queries) if queries is not None else rows).dropDuplicates(["vec_id"])
    needed = lists_needed(rows, asking, entered, graph, held, longest, ratio, k)
    if needed == lists:  # all are read, so one entry of each vector will do
        entered = entered.filter("nearest")
        counts = entered.groupBy("list").agg(F.count("*").alias("n"))
    asked = stage(read_lists(asking, graph, spark.sparkContext.broadcast(held), longest, ratio, k, needed),
                  "query-lists")
    near = asked.filter("first").withColumn("bound", F.lit(float("-inf")))
    known = stage(best_of(best_in_lists(entered, counts, near, k, chunk), k), "first-found")
    bounds = known.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    far = asked.filter("not first").join(bounds, "vec_id", "left").fillna(float("-inf"), ["bound"])
    more = best_in_lists(entered, counts, far, k, chunk)
    return best_of(known.drop("rank").unionByName(more), k)
