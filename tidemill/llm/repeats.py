"""Removing repeated passages with prefix-partitioned suffix trees over sampled suffixes.

A window is ``window`` consecutive words of one document. A word goes when a window that covers it
has the same words as a window that starts earlier (smaller doc_id, or earlier in the document).

A suffix per word of 100 TB would be moved many times over, so the trees hold sampled suffixes: every
window picks the *anchor* among its runs of ``prefix`` words with the least hash. Equal windows pick
equal anchors at equal places, so each repeat passes through suffixes that begin at an anchor and
share its prefix. Suffixes are partitioned by that prefix; prefixes met once are dropped. What is left
carries its neighbourhood: as many words to the left and right as a window through the anchor can
reach. Equal neighbourhoods are counted and collapsed before any tree is built, so a passage copied a
million times is one leaf. A prefix with at most ``group`` distinct neighbourhoods is a memory-sized
group: its suffixes are sorted, and runs of neighbours with a common prefix of ``window`` words are
the tree's deep internal nodes. Larger ones are split by the longest prefix that matters, the whole
window, which is then a node by itself.

Documents with the same words are collapsed first. Words are compared by 32-bit hashes, all
``window`` of them; hashes of 64 bits choose prefixes.

Cases: null and empty texts have no words. Rows equal in doc_id and text are one document and get
the same result; rows with equal doc_id and other texts follow each other by a hash of the text.
No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.rows import run_hashes, slices, stored, word_hashes
from tidemill.session import stage

WINDOW = 20
PREFIX = 8
#: Distinct neighbourhoods of a prefix that are sorted in memory together (80 bytes for each window of each).
GROUP = 4000

KEY = ["doc_id", "th"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def anchors_of(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that some window picks: least in the upper half of the hash, leftmost of equal ones."""
    runs = run_hashes(hashes, prefix)
    span = window - prefix + 1
    if len(runs) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    least = (runs & ~low) | np.arange(len(runs), dtype=np.uint64)
    width = 1  # least of ``width`` runs from each place on
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:width - span], least[span - width:])
    picked = (least & low).astype(np.int64)  # never goes back, as the leftmost is picked
    places = picked[np.concatenate([[True], picked[1:] != picked[:-1]])]
    return places, runs[places]


DIGEST = ("number long, doc_id long, th long, n_words long, all_sha256 string, same1 long, same2 long, "
          "places array<int>, prefixes array<long>")


def digests(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """Per document: number and checksum of its words, hashes of the whole, its anchors."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in texts:
                words = text.split()
                digest = hashlib.sha256(b" ".join(words)).digest()
                places, prefixes = anchors_of(word_hashes(words), window, prefix)
                same = np.frombuffer(digest[:16], "<i8")
                for column, value in zip(out, (len(words), digest.hex(), int(same[0]), int(same[1]),
                                               places.astype(np.int32), prefixes.view(np.int64))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.record_batch([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                  names=[f.split()[0] for f in DIGEST.split(", ")])

    numbered = keyed(docs).select(F.monotonically_increasing_id().alias("number"), *KEY, "text")
    return stage(numbered.mapInArrow(digest, DIGEST), "digests")  # stored, so the numbers stay


def contexts(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """A row per anchor of ``texts`` (doc_id, th, text, places): its prefix and neighbourhood.

    ``near`` holds 32-bit word hashes from ``left`` words before the anchor on.
    """
    reach = window - prefix

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            kept = {name: batch.column(batch.schema.get_field_index(name)).to_pylist()
                    for name in ("doc_id", "th", "places")}
            out: list[list] = [[] for _ in range(6)]
            for doc_id, th, places, text in zip(kept["doc_id"], kept["th"], kept["places"], raw):
                hashes = word_hashes(text.split())
                small = (hashes >> np.uint64(32)).astype("<u4").tobytes()
                runs = run_hashes(hashes, prefix)[places].view(np.int64)
                begins = np.maximum(0, np.array(places) - reach)
                ends = np.minimum(len(hashes), np.array(places) + window)
                out[0] += [doc_id] * len(places)
                out[1] += [th] * len(places)
                out[2] += places
                out[3].append(runs)
                out[4] += (np.array(places) - begins).tolist()
                out[5] += [small[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist())]
            yield pa.record_batch([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                pa.array(np.concatenate(out[3]) if out[3] else [], pa.int64()), pa.array(out[4], pa.int32()),
                pa.array(out[5], pa.binary())], names=["doc_id", "th", "place", "prefix", "left", "near"])

    return texts.mapInArrow(cut, "doc_id long, th long, place int, prefix long, left int, near binary")


def window_rows(left: list[int], near: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows through the anchors: owner, how far before its anchor it starts, its words."""
    owners, offsets, rows = [], [], []
    for owner, (n, words) in enumerate(zip(left, near)):
        values = np.frombuffer(words, "<u4")
        if len(values) < window:
            continue
        all_windows = sliding_window_view(values, window)
        first = n - (window - prefix)  # the window that starts earliest may start before the neighbourhood
        begin = max(0, first)
        chosen = all_windows[begin:n + 1]
        rows.append(chosen)
        owners.append(np.full(len(chosen), owner))
        offsets.append(n - np.arange(begin, begin + len(chosen)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, window), np.uint32)
    return np.concatenate(owners), np.concatenate(offsets), np.concatenate(rows)


def later_leaves(prefixes: np.ndarray, order: np.ndarray, place: np.ndarray, left: list[int], near: list[bytes],
                 window: int, prefix: int) -> np.ndarray:
    """For each leaf a bit set: bit *o* if its window *o* words before the anchor also starts earlier.

    ``order`` ranks the leaves' documents. Suffixes of all prefixes are sorted together; the prefix
    comes first, so each stays in its own subtree.
    """
    owners, offsets, rows = window_rows(left, near, window, prefix)
    bits = np.zeros(len(near), np.int64)
    if not len(rows):
        return bits
    keys = np.empty((len(rows), window + 2), ">u4")
    keys[:, :2] = prefixes[owners].astype(">i8").view(">u4").reshape(-1, 2)
    keys[:, 2:] = rows
    flat = np.ascontiguousarray(keys).view(np.dtype((np.void, keys.shape[1] * 4))).ravel()
    sort = np.argsort(flat, kind="stable")
    lcp_full = np.concatenate([[False], (keys[sort[1:]] == keys[sort[:-1]]).all(axis=1)])
    node = np.cumsum(~lcp_full) - 1
    owner, start = owners[sort], (place[owners] - offsets)[sort]
    first = np.lexsort((start, order[owner], node))  # leaves of a node by where they start
    # a periodic text reaches one window through several anchors: the earliest start itself is no repeat
    doc, at, nodes = order[owner][first], start[first], node[first]
    lead = np.flatnonzero(np.concatenate([[True], np.diff(nodes) > 0]))[nodes]
    later = first[(doc != doc[lead]) | (at != at[lead])]
    np.bitwise_or.at(bits, owner[later], np.left_shift(np.int64(1), offsets[sort][later]))
    return bits


def subtree_marks(classes: DataFrame, window: int, prefix: int) -> DataFrame:
    """``later`` bits of the earliest member of each class, for memory-sized groups."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < GROUP:
                continue
            prefixes = held.column("prefix").to_numpy()
            whole = int(np.flatnonzero(prefixes != prefixes[-1])[-1]) + 1 if prefixes[0] != prefixes[-1] else 0
            for done in groups(held.slice(0, whole)):
                yield done
            held = held.slice(whole)
        if held is not None:
            yield from groups(held)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        prefixes = table.column("prefix").to_numpy()
        cuts = np.flatnonzero(np.diff(prefixes)) + 1
        begin = 0
        for end in [*cuts.tolist(), len(prefixes)]:
            # whole groups, about GROUP leaves at a time
            if end - begin >= GROUP or end == len(prefixes):
                part = table.slice(begin, end - begin).combine_chunks()
                ids = pc.fill_null(part.column("doc_id"), np.iinfo(np.int64).min).to_numpy()  # null is least
                ranks = np.unique(np.stack([ids, part.column("th").to_numpy()], 1), axis=0, return_inverse=True)[1]
                bits = later_leaves(part.column("prefix").to_numpy(), ranks.ravel(), part.column("place").to_numpy(),
                                    part.column("left").to_pylist(), part.column("near").to_pylist(), window, prefix)
                yield pa.record_batch([
                    *[part.column(c).combine_chunks() for c in ("prefix", "near_hash")], pa.array(bits)],
                    names=["prefix", "near_hash", "later"])
                begin = end

    return (classes.repartition("prefix").sortWithinPartitions("prefix")
            .select("prefix", "near_hash", "doc_id", "th", "place", "left", "near")
            .mapInArrow(build, "prefix long, near_hash long, later long"))


def split_marks(classes: DataFrame, window: int, prefix: int) -> DataFrame:
    """The same for prefixes with too many neighbourhoods: one node per whole window, by grouping."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, offsets, rows = window_rows(batch.column(batch.schema.get_field_index("left")).to_pylist(),
                                                batch.column(batch.schema.get_field_index("near")).to_pylist(),
                                                window, prefix)
            take = pa.array(owners, pa.int64())
            place = batch.column(batch.schema.get_field_index("place")).to_numpy(zero_copy_only=False)
            yield pa.record_batch([
                *[batch.column(batch.schema.get_field_index(c)).take(take)
                  for c in ("prefix", "near_hash", "doc_id", "th")],
                pa.array(place[owners] - offsets, pa.int64()), pa.array(offsets, pa.int64()),
                pa.array([r.tobytes() for r in rows.astype("<u4")], pa.binary())],
                names=["prefix", "near_hash", "doc_id", "th", "start", "offset", "words"])

    suffixes = classes.select("prefix", "near_hash", "doc_id", "th", "place", "left", "near").mapInArrow(
        windows, "prefix long, near_hash long, doc_id long, th long, start long, offset long, words binary")
    first = suffixes.groupBy("prefix", "words").agg(F.min(F.struct("doc_id", "th", "start")).alias("first"))
    late = suffixes.join(first, ["prefix", "words"]).filter(
        ~F.struct("doc_id", "th", "start").eqNullSafe(F.col("first")))
    return late.groupBy("prefix", "near_hash").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(offset as int))")).alias("later"))


def cover(batch: pa.RecordBatch, raw: list[bytes], window: int) -> tuple[list[int], list[str]]:
    """Removed words and checksum of the rest; ``marks`` are structs of an anchor's place and its bits."""
    removed, digests_ = [], []
    for marks, text in zip(batch.column(batch.schema.get_field_index("marks")).to_pylist(), raw):
        words = text.split()
        edge = np.zeros(len(words) + 1, np.int64)
        for mark in marks:
            offset, bits = 0, mark["later"]
            while bits:
                if bits & 1:
                    start = mark["place"] - offset
                    edge[start] += 1
                    edge[start + window] -= 1
                bits >>= 1
                offset += 1
        gone = np.cumsum(edge[:-1]) > 0
        removed.append(int(gone.sum()))
        digests_.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
    return removed, digests_


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept_sha256: a row per input row."""
    found = digests(docs, window, prefix)
    # documents with the same words: the first stands for all
    same = ["same1", "same2", "n_words"]
    firsts = found.groupBy(*same).agg(F.min(F.struct(*KEY)).alias("lead"))
    told = found.select(*KEY, *same, "all_sha256").join(firsts, same).select(
        *KEY, "n_words", "all_sha256", (~F.struct(*KEY).eqNullSafe(F.col("lead"))).alias("copy"))
    told = stage(told, "copies")

    def null_safe(a: DataFrame, b: DataFrame):
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])

    # of each class one row takes part; its number is short, unlike its key
    numbers = stage(found.filter(F.col("n_words") >= window).groupBy(*same).agg(
        F.min(F.struct(*KEY)).alias("lead"), F.min("number").alias("number")), "numbers")
    anchors = (found.join(numbers.select("number"), "number", "left_semi")
               .select("number", F.explode(F.arrays_zip("places", "prefixes")).alias("a"))
               .select("number", F.col("a.places").alias("place"), F.col("a.prefixes").alias("prefix")))
    shared = (anchors.withColumn("n", F.count("*").over(Window.partitionBy("prefix")))
              .filter("n > 1").groupBy("number").agg(F.sort_array(F.collect_list("place")).alias("places"))
              .join(numbers, "number").select("lead.*", "places"))
    texts = keyed(docs)
    held = stored(texts.join(shared, null_safe(texts, shared)).select(texts["doc_id"], texts["th"], "text", "places"),
                  "passages", "zstd")
    if told.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        held = held.dropDuplicates(KEY)  # rows equal in doc_id and text
    # read twice rather than stored: a neighbourhood is as long as 32 words, and most are dropped
    near = contexts(held, window, prefix).withColumn("near_hash", F.xxhash64("left", "near"))
    classes = near.groupBy("prefix", "near_hash").agg(
        F.min(F.struct(*KEY, "place")).alias("first"), F.first("left").alias("left"), F.first("near").alias("near"),
        F.count("*").alias("members"))
    classes = stored(classes.select("prefix", "near_hash", "first.*", "left", "near", "members"), "leaves", "zstd")
    large = classes.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("prefix")
    large = stage(large, "large-prefixes")
    if large.limit(1).count():
        marks = subtree_marks(classes.join(large, "prefix", "left_anti"), window, prefix).unionByName(
            split_marks(classes.join(large, "prefix", "left_semi"), window, prefix))
    else:
        marks = subtree_marks(classes, window, prefix)
    # in every member but the first all windows start earlier elsewhere
    leaves = classes.select("prefix", "near_hash", "members", F.struct(*KEY, "place").alias("first")).join(
        marks, ["prefix", "near_hash"], "left").filter("members > 1 or coalesce(later, 0) != 0")
    reach = window - prefix
    last = F.greatest(F.lit(0), F.col("left") + window - F.col("size"))  # least and most offset that fit
    every = F.expr("shiftleft(1L, cast(most + 1 as int)) - shiftleft(1L, cast(least as int))")
    members = near.select(*KEY, "place", "prefix", "near_hash", "left", (F.length("near") / 4).cast("int").alias("size"))
    marked = (members.join(leaves, ["prefix", "near_hash"])
              .withColumn("most", F.least(F.col("left"), F.lit(reach)))
              .withColumn("least", last)
              .withColumn("bits", F.when(F.struct(*KEY, "place").eqNullSafe(F.col("first")), F.coalesce("later", F.lit(0)))
                          .otherwise(F.when(F.col("most") >= F.col("least"), every).otherwise(F.lit(0))))
              .filter("bits != 0")
              .groupBy(*KEY).agg(F.collect_list(F.struct("place", F.col("bits").alias("later"))).alias("marks")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            removed, digests_ = cover(batch, raw, window)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                                   pa.array(digests_, pa.string())], names=["doc_id", "th", "removed", "sha"])

    cut = held.join(marked, null_safe(held, marked)).select(
        held["doc_id"], held["th"], "text", "marks").mapInArrow(
        finish, "doc_id long, th long, removed long, sha string")
    whole = F.col("copy") & (F.col("n_words") >= window)
    return told.join(cut, null_safe(told, cut), "left").select(
        told["doc_id"], "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("sha", "all_sha256")).alias("kept_sha256"))
