"""Packing token pieces into as few sequences as possible with a grouping genetic algorithm.

Pieces shorter than a sequence are dealt by hash into shards of bounded size that fill several sequences. Several islands evolve
packings of each shard, each in its own task; after every epoch the islands pass their best packing
on to the next island. In a packing the bins are the genes: a crossover puts whole well-filled
bins of one parent into the other, drops the bins that hold the same pieces, and gives the displaced
pieces to the bins they fit best. The worst-filled bins of all shards are dissolved and packed
again, until they fit one shard or do not get fewer.

Cases: null and empty texts are one end id. Equal rows are packed as separate documents. No rows
give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.rows import base_columns, slices
from tidemill.llm.tokens import encoder, forget
from tidemill.session import stage

#: Words in each half of a worker's word table; the same workers pack afterwards, with pandas loaded.
WORDS = 300_000
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 12
GENERATIONS = 60
#: Bins of a shard that are packed again with those of other shards.
REPACKED_BINS = 2
#: A shard has tokens for so many bins, so that most of its packing stays; with short pieces that takes more than
#: SHARD_ITEMS of them, but no more than its tokens.
SHARD_BINS = 8

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int,
                 table_words: int = WORDS) -> DataFrame:
    """A row per piece, stored: every document's ids and the end id, cut only where they exceed a sequence."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, table_words)
        end = np.array([end_id], encode.dtype)
        for batch, texts in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for (row, doc), ids in zip(keys, encode.encode(texts)):
                tokens = np.concatenate([np.frombuffer(ids, encode.dtype), end]).astype("<u4")
                for piece, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start:start + capacity]
                    for column, value in zip(out, (row, doc, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)],
                                  names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    texts = base_columns(docs, doc_id="doc_id", text="text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stage(texts.mapInArrow(cut, PIECES), "pieces")


Bins = list[list[int]]


def best_fit(bins: Bins, free: list[int], sizes: np.ndarray, items: np.ndarray, capacity: int) -> None:
    """Put items, largest first, into the fullest bins that still take them, or new ones."""
    order = sorted((room, i) for i, room in enumerate(free))
    for item in items[np.argsort(-sizes[items], kind="stable")].tolist():
        size = int(sizes[item])
        at = bisect.bisect_left(order, (size, -1))
        if at < len(order):
            room, i = order.pop(at)
        else:
            room, i = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[i].append(item)
        free[i] = room - size
        if free[i]:
            bisect.insort(order, (free[i], i))


def starts_of(bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of the bins in a row, and where each bin begins; no bin is empty."""
    return np.fromiter(chain.from_iterable(bins), np.int64), np.cumsum([0, *map(len, bins[:-1])])


def loads_of(bins: Bins, sizes: np.ndarray) -> np.ndarray:
    if not bins:
        return np.zeros(0, np.int64)
    pieces, starts = starts_of(bins)
    return np.add.reduceat(sizes[pieces], starts)


def fitness(free: np.ndarray, capacity: int) -> float:
    """Fewer and more unevenly filled bins are better."""
    filled = 1 - free / capacity
    return float(np.mean(filled ** 2)) if len(free) else 1.0


def crossover(a: Bins, b: Bins, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Child of ``a`` with well-filled bins of ``b`` injected whole."""
    loads = loads_of(b, sizes)
    full = np.flatnonzero(loads >= np.quantile(loads, 0.5))
    chosen = rng.choice(full, size=max(1, len(full) // 4), replace=False)
    injected = [b[i] for i in chosen.tolist()]
    taken = np.zeros(len(sizes), bool)
    taken[[i for x in injected for i in x]] = True
    kept, displaced = [], []
    pieces, starts = starts_of(a)
    for x, hit in zip(a, np.logical_or.reduceat(taken[pieces], starts).tolist()):
        if hit:
            displaced += [i for i in x if not taken[i]]
        else:
            kept.append(x)
    return refill(kept + injected, displaced, sizes, capacity)


def refill(bins: Bins, displaced: list[int], sizes: np.ndarray, capacity: int) -> Bins:
    child = [list(x) for x in bins]
    free = (capacity - loads_of(child, sizes)).tolist()
    best_fit(child, free, sizes, np.array(displaced, int), capacity)
    return child


def mutate(bins: Bins, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Dissolve a few of the emptier bins and place their pieces anew."""
    loads = loads_of(bins, sizes)
    worst = np.argsort(loads, kind="stable")[:max(2, len(bins) // 10)]
    gone = set(rng.choice(worst, size=min(len(worst), 2), replace=False).tolist())
    displaced = [i for k in gone for i in bins[k]]
    return refill([x for k, x in enumerate(bins) if k not in gone], displaced, sizes, capacity)


def as_genes(bins: Bins, n: int) -> np.ndarray:
    genes = np.empty(n, np.int32)
    for k, x in enumerate(bins):
        genes[x] = k
    return genes


def as_bins(genes: np.ndarray) -> Bins:
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.diff(genes[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray],
           individuals: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """Best packing found by one island in one epoch; ``elites`` are packings from before.

    A packing with no more bins than its tokens fill cannot be beaten, so the search ends with it.
    """
    rng = np.random.default_rng(seed)
    n, least = len(sizes), -(-int(sizes.sum()) // capacity)
    population = [as_bins(e) for e in elites]
    if not population:
        first: Bins = []
        best_fit(first, [], sizes, np.arange(n), capacity)
        population.append(first)
    fewest = min(population, key=len)
    if len(fewest) <= least:
        return as_genes(fewest, n)
    while len(population) < individuals:  # best fit of a random order, in blocks by falling size
        jitter = np.maximum(1, sizes * rng.uniform(0.9, 1.1, n))
        bins: Bins = []
        free: list[int] = []
        for block in np.array_split(np.argsort(-jitter, kind="stable"), 8):
            best_fit(bins, free, sizes, block, capacity)
        population.append(bins)
    score = lambda x: fitness(capacity - loads_of(x, sizes), capacity)
    scores = [score(x) for x in population]
    for _ in range(generations):
        best = int(np.argmax(scores))
        if len(population[best]) <= least:
            break
        mother, father = rng.choice(len(population), 2, replace=False).tolist()
        for child in (crossover(population[mother], population[father], sizes, capacity, rng),
                      mutate(population[best], sizes, capacity, rng)):
            worst = int(np.argmin(scores))
            value = score(child)
            if value > scores[worst]:
                population[worst], scores[worst] = child, value
    return as_genes(population[int(np.argmax(scores))], n)


ITEMS = "row long, piece int, length long"
STATE = "shard long, island int, score double, genes binary"


def pack_shards(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, seed: int,
                individuals: int, generations: int) -> DataFrame:
    """Columns row, piece, length, shard, bin, load: the best packing of each shard, stored."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(seed)), F.lit(shards)))
    spread = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))

    def epoch(number: int):
        def run(items_pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            if not len(items_pdf):
                return pd.DataFrame({"shard": [], "island": [], "score": [], "genes": []})
            forget()  # the pieces are stored
            pdf = items_pdf.sort_values(["row", "piece"])
            sizes = pdf["length"].to_numpy(np.int64)
            shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
            elites = [np.frombuffer(g, "<i4") for g in states.sort_values("score")["genes"]]
            genes = evolve(sizes, capacity, hash((seed, shard, island, number)) & 0x7FFFFFFF, elites,
                           individuals, generations)
            loads = np.bincount(genes, sizes)
            return pd.DataFrame({"shard": [shard], "island": [island], "genes": [genes.astype("<i4").tobytes()],
                                 "score": [float(np.mean((loads / capacity) ** 2))]})
        return run

    state = dealt.sparkSession.createDataFrame([], STATE)
    for number in range(epochs):
        # an island keeps its own best packing and receives that of its neighbour
        moved = state if not number else state.withColumn("to", F.explode(F.array(
            F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands))))).select(
            "shard", F.col("to").alias("island"), "score", "genes")
        state = (spread.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island"))
                 .applyInPandas(epoch(number), STATE))
        if number + 1 < epochs:
            state = stage(state, "islands")
    best = state.groupBy("shard").agg(F.max_by("genes", F.struct("score", -F.col("island"))).alias("genes"))

    def place(items_pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        pdf = items_pdf.sort_values(["row", "piece"])
        if not len(pdf):
            return pdf.assign(bin=[], load=[])
        genes = np.frombuffer(states["genes"].iloc[0], "<i4")
        loads = np.bincount(genes, pdf["length"].to_numpy(np.int64)).astype(np.int64)
        return pdf.assign(bin=genes, load=loads[genes])

    placed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(
        place, ITEMS + ", shard long, bin int, load long")
    return stage(placed, "packed")


def pack(pieces: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7,
         individuals: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """Columns row, piece, sequence_id, offset for stored pieces (row, piece, length)."""
    full = pieces.filter(F.col("length") == capacity).select(
        "row", "piece", "length", (-1 - F.monotonically_increasing_id()).alias("sequence_id"))
    items = pieces.filter(F.col("length") < capacity).select("row", "piece", "length")
    done, first, level = [full], 0, 0
    size = lambda x: x.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    n, tokens = size(items)
    while True:
        shards = max(1, min(-(-n // SHARD_ITEMS), tokens // (capacity * SHARD_BINS)))
        packed = pack_shards(items, shards, capacity, islands, epochs, seed + level, individuals, generations)
        ids = F.lit(first) + F.col("shard") * SHARD_ITEMS * 4 + F.col("bin")
        if shards == 1:
            done.append(packed.select("row", "piece", "length", ids.alias("sequence_id")))
            break
        bins = packed.groupBy("shard", "bin").agg(F.first("load").alias("load"))
        # a row per bin; the emptiest few of each shard are dissolved
        worst = bins.groupBy("shard").agg(F.slice(F.sort_array(F.collect_list(F.struct("load", "bin"))), 1,
                                                  REPACKED_BINS).alias("worst"))
        flagged = packed.join(worst, "shard").withColumn(
            "again", F.exists("worst", lambda w: w["bin"] == F.col("bin")))
        flagged = stage(flagged.select("row", "piece", "length", ids.alias("sequence_id"), "again"), "level")
        items = flagged.filter("again").select("row", "piece", "length")
        left, tokens = size(items)
        if left >= n:  # no bin would stay: this packing is the last
            done.append(flagged.select("row", "piece", "length", "sequence_id"))
            break
        done.append(flagged.filter("not again").select("row", "piece", "length", "sequence_id"))
        n, first, level = left, first + shards * SHARD_ITEMS * 4, level + 1

    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)

    order = Window.partitionBy("sequence_id").orderBy("row", "piece")
    return placed.select("row", "piece", "sequence_id",
                         (F.sum("length").over(order) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048,
                   table_words: int = WORDS, **settings) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    A worker remembers the ids of twice ``table_words`` words at most, some 200 bytes each, until it packs.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, table_words)
    placed = pack(pieces, capacity, **settings)
    return pieces.join(placed, ["row", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
