"""Ranked lexical search of all documents for many items at once, with the sums they share made once.

A document's score for an item is a sum over the item's terms. Items that hold the same terms share
parts of their sums, so these are mined first: the two parts that occur together in most items become
one new part, as long as some pair occurs together twice. That gives a graph whose leaves are single
terms and whose inner nodes are sums of two others. For a block of documents every node's accumulator
is made once, level by level, and an item's score is the sum of the few nodes that are left of it.

The documents are read once to count the terms that items ask for, in a table of document, length,
term numbers and occurrences. A second pass over that small table scores blocks of documents and
keeps, in each task, every item's ``k`` best so far; only they are shuffled, and merged in two steps.
All scores are 64-bit integers, so the order of the additions does not matter.

Items are taken in blocks of bounded size (``ITEMS``, ``ITEM_BYTES``), each with a vocabulary and a graph
of its own and with its own two passes: what goes to the driver and to the tasks is bounded by the
block, and scoring a full block costs more than reading the texts for it.

Cases: null and empty texts have no terms; such documents and items give no rows. Rows of documents
are documents of their own, equal or not; a null doc_id comes last among equal scores. Rows with equal
item_id are one item with the terms of all its different texts. No rows give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.rows import base_columns, slices
from tidemill.session import stage

#: Items, and bytes of their texts, that share one graph.
ITEMS = 1024
ITEM_BYTES = 8 << 20
#: Longer items are mined in parts of so many terms, as pairs are counted.
PART_TERMS = 48
#: Accumulators a task holds at a time.
BLOCK_BYTES = 32 << 20
#: Groups in which an item's candidates are merged first.
SALTS = 16

#: Bytes that end a term become spaces, A-Z small; all bytes of longer characters belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
             for c in range(256))

FOUND = "item_id long, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class SharedSums:
    """The graph of sums for a block of items, each given as {term number: occurrences}.

    Rows of the accumulator: one per term, one per term that an item holds several times, then the sums
    in levels, each of nodes before it. ``additions`` counts them all, ``plain`` what they would be unshared.
    """

    def __init__(self, items: list[dict[int, int]], n_terms: int):
        several = sorted({(t, c) for item in items for t, c in item.items() if c > 1})
        place = {key: n_terms + i for i, key in enumerate(several)}
        self.several_term = np.array([t for t, _ in several], np.int64)
        self.several_count = np.array([c for _, c in several], np.int64)
        leaves = n_terms + len(several)
        held = [[place.get((t, c), t) for t, c in item.items()] for item in items]
        sums, left = self._mine(held, leaves)
        self._number(sums, leaves)
        roots = [[self.renumbered.get(x, x) for x in row] for row in left]
        self.roots = np.array(list(chain.from_iterable(roots)), np.int64)
        self.root_starts = np.cumsum([0] + [len(r) for r in roots])[:-1].astype(np.int64)
        self.plain = sum(len(r) - 1 for r in held)
        self.additions = len(sums) + sum(len(r) - 1 for r in roots)
        self.rows = leaves + len(sums)

    @staticmethod
    def _mine(held: list[list[int]], first: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
        """Sums of two nodes, in the order they are made, and what is left of each item."""
        often = Counter(chain.from_iterable(held))
        left: list[list[int]] = [[x for x in row if often[x] == 1] for row in held]
        parts: list[set[int]] = []
        owner: list[int] = []
        for i, row in enumerate(held):  # in one order for all, so that common terms meet in the same part
            shared = sorted((x for x in row if often[x] > 1), key=lambda x: (-often[x], x))
            for at in range(0, len(shared), PART_TERMS):
                parts.append(set(shared[at:at + PART_TERMS]))
                owner.append(i)
        together: Counter = Counter()
        holders: dict[int, set[int]] = defaultdict(set)
        for p, part in enumerate(parts):
            together.update(combinations(sorted(part), 2))
            for x in part:
                holders[x].add(p)
        queue = [(-n, pair) for pair, n in together.items() if n > 1]
        heapq.heapify(queue)
        sums: list[tuple[int, int]] = []
        pair_of = lambda x, y: (x, y) if x < y else (y, x)
        while queue:
            n, (a, b) = heapq.heappop(queue)
            now = together[a, b]
            if now != -n:  # has become rarer since it was queued
                if now > 1:
                    heapq.heappush(queue, (-now, (a, b)))
                continue
            node = first + len(sums)
            sums.append((a, b))
            met: Counter = Counter()
            for p in holders[a] & holders[b]:
                part = parts[p]
                part -= {a, b}
                holders[a].discard(p)
                holders[b].discard(p)
                for x in part:
                    together[pair_of(a, x)] -= 1
                    together[pair_of(b, x)] -= 1
                    met[x, node] += 1
                part.add(node)
                holders[node].add(p)
            together[a, b] = 0
            together.update(met)
            for pair, k in met.items():
                if k > 1:
                    heapq.heappush(queue, (-k, pair))
        for p, part in enumerate(parts):
            left[owner[p]] += sorted(part)
        return sums, left

    def _number(self, sums: list[tuple[int, int]], leaves: int) -> None:
        """Numbers sums by level, so that a level is a range of rows."""
        level: list[int] = []
        for a, b in sums:
            level.append(1 + max(level[x - leaves] if x >= leaves else 0 for x in (a, b)))
        order = sorted(range(len(sums)), key=lambda i: level[i])
        self.renumbered = {leaves + old: leaves + new for new, old in enumerate(order)}
        self.levels = []
        for depth in range(1, max(level, default=0) + 1):
            own = [i for i in order if level[i] == depth]
            a, b = (np.array([self.renumbered.get(sums[i][side], sums[i][side]) for i in own]) for side in (0, 1))
            begin = self.renumbered[leaves + own[0]]
            self.levels.append((begin, begin + len(own), a, b))

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> np.ndarray:
        """Items by documents, given the values of single terms."""
        held = np.zeros((self.rows, n_docs), np.int64)
        held[term, doc] = value
        if len(self.several_term):
            held[n_terms:n_terms + len(self.several_term)] = (
                held[self.several_term] * self.several_count[:, None])
        for begin, end, a, b in self.levels:
            np.add(held[a], held[b], out=held[begin:end])
        return np.add.reduceat(held[self.roots], self.root_starts, axis=0)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a score below it is of no use any more
        self.columns = [np.empty(0, np.int64) for _ in range(4)]  # item, score, doc_id is null, doc_id

    def add(self, scores: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        new = (item, scores[item, at], nulls[at], doc_ids[at])
        columns = [np.concatenate(x) for x in zip(self.columns, new)]
        order = np.lexsort((columns[3], columns[2], -columns[1], columns[0]))
        item = columns[0][order]
        begins = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        sizes = np.diff(np.append(begins, len(item)))
        kept = order[np.arange(len(item)) - np.repeat(begins, sizes) < self.k]
        self.columns = [c[kept] for c in columns]
        full = sizes >= self.k
        self.least[item[begins[full]]] = columns[1][order[begins[full] + self.k - 1]]


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Columns doc_id, n, terms, tf, stored: a row per document, with the terms of the vocabulary it holds."""
    size = max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = [terms(t) for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words))
            number = np.fromiter(map(vocabulary.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(n)), n)
            known = number >= 0
            met, tf = np.unique(doc[known] * size + number[known], return_counts=True)
            doc, term = np.divmod(met, size)
            ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.record_batch([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])

    read = base_columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return stage(read.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>"), "term-counts")


def weights(counts: DataFrame, n_terms: int, documents: int) -> np.ndarray:
    """The weight of each term of the vocabulary, from the number of documents that hold it."""
    out = np.zeros(n_terms, np.int64)
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
    for term, df in held.collect():  # at most the vocabulary of a block of items
        out[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return out


def best_of_block(counts: DataFrame, ids: list[int | None], items: list[dict[int, int]], weight: np.ndarray,
                  documents: int, length: int, k: int) -> DataFrame:
    """Columns item_id, doc_id, score: the k best of every task for each item."""
    graph, n_terms = SharedSums(items, len(weight)), len(weight)
    at_once = max(8, BLOCK_BYTES // (8 * (graph.rows + len(graph.roots) + len(items))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for batch in batches:
            for at in range(0, len(batch), at_once):
                part = batch.slice(at, at_once)
                n = part.column(1).to_numpy()
                m = 75 + 25 * n * documents // length
                lists = part.column(2)
                doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                best.add(graph.scores(len(part), doc, term, value, n_terms),
                         part.column(0).fill_null(0).to_numpy(),
                         part.column(0).is_null().to_numpy(zero_copy_only=False))
        item, score, null, doc_id = best.columns
        yield pa.record_batch([pa.array(ids, pa.int64()).take(pa.array(item)),
                               pa.array(doc_id, pa.int64(), mask=null.astype(bool)), pa.array(score)],
                              names=["item_id", "doc_id", "score"])

    return counts.filter("size(terms) > 0").mapInArrow(search, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Columns item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 for every item."""
    spark = docs.sparkSession
    asked = base_columns(items, item_id="item_id", text="text").select(
        F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, size = asked.agg(F.countDistinct(F.struct("item_id")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    found, totals = [], None
    for block in range(blocks):
        by_id: dict[int | None, Counter] = defaultdict(Counter)
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        for item_id, text in own.collect():  # bounded by the block
            by_id[item_id].update(terms(None if text is None else text.encode()))
        by_id = {i: by_id[i] for i in sorted(by_id, key=lambda i: (i is None, i)) if by_id[i]}
        if not by_id:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*by_id.values())))}
        counts = counted(docs, vocabulary)
        if totals is None:
            totals = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not totals[0]:
            break
        found.append(best_of_block(
            counts, list(by_id), [{vocabulary[t]: c for t, c in x.items()} for x in by_id.values()],
            weights(counts, len(vocabulary), totals[0]), totals[0], totals[1], k))
    all_found = reduce(DataFrame.union, found) if found else spark.createDataFrame([], FOUND)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = all_found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
           .filter(F.col("rank") <= k))
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            .filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
