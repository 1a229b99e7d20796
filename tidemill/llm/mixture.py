"""Packing all documents into windows that hold every source in its target proportion.

Sources are queues of tokens, served by deficit round-robin: in each round (a window of ``window`` tokens)
a queue's deficit grows by its quantum, its share of the window, and it sends packets of ``packet`` tokens
as long as the deficit pays for one; what is left is carried to the next window. A queue that runs dry
drops out, and the rounds get shorter. The rounds, one after another, are one stream of tokens, cut into
full sequences; what is left at its end is cut into powers of two, so nothing is padded.

As quanta do not change, a queue has sent the packets that ``round * quantum`` pays for by the end of a
round. So the round of any token, and where that round begins in the stream, follow from the queue's
place of the token and the lengths of all queues. Nothing is played through one after another: the documents are
encoded and stored once, where they are; the lengths of a queue's parts (one for each task) are summed up in
order, which carries deficits across partitions; then each task places its own documents. No text and no ids are
shuffled by it.

There are at most window / packet queues of one source each, those whose share of the text, or whose
target, pays for a packet in every window; all smaller ones share as many queues, by hash.

Cases: null and empty texts are the end id alone. Null is a source. Rows are documents of their own,
equal or not. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.byte_tokens import byte_encoder
from tidemill.llm.rows import base_columns, slices
from tidemill.session import stage

#: Tokens of a window, and of the least that a queue sends at once.
WINDOW = 64 * 2048
PACKET = 512
#: Fractions of a token in a quantum, as a power of two.
FRACTION = 16
#: Documents and rounds that are placed at a time.
DOCUMENTS, ROUNDS = 2000, 4096


def ceiling(a, b):
    return -(-a // b)


class Schedule:
    """Where every token of every queue comes in the stream, from the queues' lengths and quanta.

    ``totals`` are the tokens of each queue, ``shares`` their part of each window (any positive scale).
    """

    def __init__(self, totals: list[int], shares: list[float | int], window: int, packet: int, capacity: int):
        self.packet, self.capacity = packet, capacity
        whole = sum(shares)
        self.quantum = np.array([
            max(1, (window << FRACTION) * s // whole if isinstance(whole, int) else int((window << FRACTION) * s / whole))
            for s in shares], np.int64)
        self.totals = np.array(totals, np.int64)
        # queues begin with different deficits, so that equal ones do not all send in the same rounds
        self.deficit = np.array([(i * 40503 % 65536) * packet >> 16 for i in range(len(totals))], np.int64)
        self.rounds = np.maximum(1, ceiling((self.totals - self.deficit) << FRACTION, self.quantum))
        self.tokens = sum(totals)
        full, rest = divmod(self.tokens, capacity)
        # ends of the sequences behind the full ones
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full = full
        self.ends = full * capacity + np.cumsum(np.array([0, *sizes], np.int64))

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Rounds by queues: tokens that a queue has sent by the end of a round."""
        r = np.minimum(rounds[:, None] + 1, self.rounds)
        paid = (r * self.quantum >> FRACTION) + self.deficit
        sent = np.where(paid >= self.totals, self.totals, paid // self.packet * self.packet)
        return np.where(rounds[:, None] < 0, 0, sent)

    def round_of(self, queue: np.ndarray, packet: np.ndarray) -> np.ndarray:
        """The round that sends a queue's packet."""
        needs = np.minimum((packet + 1) * self.packet, self.totals[queue]) - self.deficit[queue]
        return np.maximum(0, ceiling(needs << FRACTION, self.quantum[queue]) - 1)

    def places(self, queue: np.ndarray, at: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Places in the stream of tokens ``at`` of their queues, given their rounds."""
        known, which = np.unique(rounds, return_inverse=True)
        out = np.empty(len(at), np.int64)
        order = np.argsort(which, kind="stable")
        for begin in range(0, len(known), ROUNDS):
            lo, hi = np.searchsorted(which[order], [begin, begin + ROUNDS])
            rows = order[lo:hi]
            now = known[begin:begin + ROUNDS]
            before, after = self.sent(now - 1), self.sent(now)
            ahead = before.sum(axis=1, keepdims=True) + np.cumsum(after - before, axis=1) - (after - before)
            w = which[rows] - begin
            out[rows] = ahead[w, queue[rows]] + at[rows] - before[w, queue[rows]]
        return out

    def sequence_of(self, place: np.ndarray) -> np.ndarray:
        tail = self.full + np.searchsorted(self.ends, place, side="right") - 1
        return np.where(place < self.full * self.capacity, place // self.capacity, tail)

    def sequence_start(self, sequence: np.ndarray) -> np.ndarray:
        tail = self.ends[np.clip(sequence - self.full, 0, len(self.ends) - 1)]
        return np.where(sequence < self.full, sequence * self.capacity, tail)

    def pieces(self, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, start, length, round, sequence and offset of every piece.

        Document i is the ``n[i]`` tokens of its queue from ``begin[i]`` on.
        """
        first = begin // self.packet
        doc, number = spread((begin + n - 1) // self.packet - first + 1)
        packet = first[doc] + number
        rounds = self.round_of(queue[doc], packet)
        at = np.maximum(begin[doc], packet * self.packet)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (rounds[1:] != rounds[:-1])
        doc, at, rounds = doc[new], at[new], rounds[new]
        size = ends_of(doc, at, (begin + n)[doc]) - at
        place = self.places(queue[doc], at, rounds)
        # where no other queue sends in between, the next round goes on with the same piece
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + size[:-1])
        doc, at, rounds, place = doc[new], at[new], rounds[new], place[new]
        size = ends_of(doc, at, (begin + n)[doc]) - at
        low = self.sequence_of(place)
        piece, number = spread(self.sequence_of(place + size - 1) - low + 1)
        sequence = low[piece] + number
        start = self.sequence_start(sequence)
        here = np.maximum(place[piece], start)
        end = np.minimum((place + size)[piece], self.sequence_start(sequence + 1))
        doc = doc[piece]
        return (doc, at[piece] + here - place[piece] - begin[doc], end - here, rounds[piece], sequence, here - start)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its index so many times, and the numbers from 0 on."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def ends_of(doc: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ends of runs of tokens: where the next one of the same document begins, or the document's end."""
    end = last.copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = at[1:][same]
    return end


def own_queues(docs: DataFrame, targets: dict[str | None, float], least: float) -> list[str | None]:
    """The sources that have a queue to themselves: at most 1 / least, and those with a target."""
    sizes = docs.groupBy("source").agg((F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) + F.count("*")).alias("size"))
    whole = sizes.agg(F.sum("size")).first()[0] or 0
    large = [r["source"] for r in sizes.filter(F.col("size") >= whole * least).collect()]
    return sorted({*large, *targets}, key=lambda s: (s is not None, s))


def encoded(docs: DataFrame, tokenizer: str, end_id: int, own: list[str | None], shared: int) -> DataFrame:
    """Columns doc_id, queue, part, at, n, ids, stored: a row per document.

    ``part`` is the task that wrote the row, ``at`` the tokens of the same queue in that part before it.
    """
    numbers = {s: i for i, s in enumerate(own)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = byte_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], known.dtype).tobytes()
        held: dict[int, int] = {}
        for batch, texts in slices(batches):
            ids = [x + end for x in known.encode(texts)]
            sizes = [len(x) // known.dtype.itemsize for x in ids]
            queues, at = [], []
            for source, n in zip(batch.column(1).to_pylist(), sizes):
                queue = numbers.get(source)
                if queue is None:
                    queue = len(numbers) + zlib.crc32((source or "").encode()) % shared
                queues.append(queue)
                at.append(held.get(queue, 0))
                held[queue] = at[-1] + n
            yield pa.record_batch([
                batch.column(0), pa.array(queues, pa.int32()), pa.array([part] * len(ids), pa.int32()),
                pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "queue", "part", "at", "n", "ids"])

    schema = "doc_id long, queue int, part int, at long, n long, ids binary"
    return stage(docs.select("doc_id", "source", "text").mapInArrow(encode, schema), "encoded")


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "queue int, round long")


def pack_mixture(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048,
                 targets: dict[str | None, float] | None = None, window: int = WINDOW,
                 packet: int = PACKET) -> DataFrame:
    """Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, round: a row per piece.

    ``targets`` are shares of every window for some sources; the others divide what is left of 1 as their
    tokens are to each other. Without targets all queues run dry together.
    """
    targets = targets or {}
    if any(not 0 < t <= 1 for t in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are positive and sum to 1 at most")
    read = base_columns(docs, doc_id="doc_id", source="source", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    own = own_queues(read, targets, packet / window)
    held = encoded(read, tokenizer, end_id, own, max(1, window // packet))
    parts = held.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    # a row per queue and task
    before = stage(parts.select("queue", "part", (F.sum("n").over(
        Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("before"), "n"), "queue-parts")
    totals = {r[0]: r[1] for r in before.groupBy("queue").agg(F.sum("n")).collect()}  # at most 2 * window / packet
    queues = range(max(totals, default=-1) + 1)
    lengths = [totals.get(q, 0) for q in queues]
    if targets:
        given = [targets.get(own[q]) if q < len(own) else None for q in queues]
        others = sum(n for n, t in zip(lengths, given) if t is None) or 1
        rest = max(0.0, 1 - sum(targets.values()))
        shares = [rest * n / others if t is None else t for n, t in zip(lengths, given)]
    else:
        shares = lengths
    schedule = Schedule(lengths, shares, window, packet, capacity) if totals else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = byte_encoder(tokenizer).dtype
        for batch in batches:
            for low in range(0, len(batch), DOCUMENTS):
                rows = batch.slice(low, DOCUMENTS)
                queue, begin, n = (rows.column(i).to_numpy() for i in (1, 2, 3))
                doc, start, length, rounds, sequence, offset = schedule.pieces(queue, begin, n)
                ids, known, crcs = rows.column(4), -1, []
                for d, s, size in zip(doc.tolist(), start.tolist(), length.tolist()):
                    if d != known:
                        known, tokens = d, np.frombuffer(ids[d].as_buffer(), dtype).astype("<u4")
                    crcs.append(zlib.crc32(tokens[s:s + size]))
                yield pa.record_batch([
                    rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                    pa.array(n[doc]), pa.array(sequence), pa.array(offset), pa.array(queue[doc]), pa.array(rounds)],
                    names=[c.split()[0] for c in PIECES.split(", ")])

    return held.join(before.drop("n"), ["queue", "part"]).select(
        "doc_id", "queue", (F.col("before") + F.col("at")).alias("begin"), "n", "ids").mapInArrow(place, PIECES)
