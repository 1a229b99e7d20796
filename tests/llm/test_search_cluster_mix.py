"""Shared lexical search, clustering and mixture packing against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import clashing, frame
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import byte_tokens, centroids, lexical, mixture

BYTE_TOKENIZER = tokenizer_path("byte_bpe_50k.json")

# 11: lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def term_list(text):
    return TERM.findall((text or "").translate(brute.LOW))


def ranked(docs, items, k):
    held = [(r[0], Counter(term_list(r[1]))) for r in docs]
    documents = sum(1 for _, t in held if t)
    length = sum(sum(t.values()) for _, t in held)
    df = Counter(x for _, t in held for x in t)
    by_id = defaultdict(list)
    for item_id, text in {tuple(r) for r in items}:
        by_id[item_id] += term_list(text)
    out = {}
    for item_id, asked in by_id.items():
        scores = []
        for doc, t in held:
            m = 75 + 25 * sum(t.values()) * documents // length if t else 0
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1)))
                        * (10 ** 9 * t[x] // (1000 * t[x] + 12 * m)) for x in asked if x in t)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out[item_id] = [(None if null else d, -s) for s, null, d in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def some_items(rows):
    rng = random.Random(8)
    texts = [r[1] for r in rows if r[1] and len(r[1]) < 2000]
    items = [[i, " ".join(rng.choice(texts).split()[:rng.randint(1, 40)])] for i in range(30)]
    items += [[30, items[0][1] + " " + items[1][1]], [31, items[0][1] + " " + items[2][1]], [32, "one one One-one, two"],
              [33, None], [34, ""], [35, "#*$%&"], [36, "notfoundanywhere"], [None, items[3][1]], [5, items[5][1]],
              [6, "another text of item six long3 long4"], [37, " ".join(f"long{i}" for i in range(700))]]
    return items


@pytest.mark.parametrize(("block", "part"), [(1024, 48), (7, 5)])
def test_ranked_search(spark, rows, monkeypatch, block, part):
    monkeypatch.setattr(lexical, "ITEMS", block)
    monkeypatch.setattr(lexical, "PART_TERMS", part)
    docs = rows + [[2000 + i, rows[0][1], "en", "s", 1] for i in range(40)]  # ties beyond the rank asked for
    items = some_items(rows)
    got = defaultdict(list)
    found = lexical.search(clashing(frame(spark, docs)).drop("rank").withColumn("score", F.lit(1)),
                           clashing(frame(spark, items, ITEMS)), k=20)
    for r in found.orderBy("item_id", "rank").collect():
        assert r["rank"] == len(got[r["item_id"]]) + 1
        got[r["item_id"]].append((r["doc_id"], r["score"]))
    assert got == ranked(docs, items, 20)


def test_ranked_search_of_nothing(spark, rows):
    empty = frame(spark, [], ITEMS)
    assert lexical.search(frame(spark, rows), empty).count() == 0
    assert lexical.search(frame(spark, []), frame(spark, [[1, "one"]], ITEMS)).count() == 0
    assert lexical.search(frame(spark, [[1, None, None, None, None]]), frame(spark, [[1, "one"]], ITEMS)).count() == 0


def test_sums_are_shared():
    rng = random.Random(2)
    common = [rng.sample(range(60), 12) for _ in range(4)]
    items = [Counter({t: rng.choice((1, 1, 1, 2)) for t in {*rng.choice(common), *rng.sample(range(60), 5)}})
             for _ in range(40)]
    graph = lexical.SharedSums(items, 60)
    doc, term = np.divmod(np.arange(5 * 60), 60)
    value = np.array([rng.randrange(1000) for _ in term])
    scores = graph.scores(5, doc, term, value, 60)
    for i, item in enumerate(items):
        for d in range(5):
            assert scores[i, d] == sum(c * value[d * 60 + t] for t, c in item.items())
    assert graph.additions < 0.7 * graph.plain


# 12: clusters

VECTORS = "vec_id long, embedding array<double>"


def some_vectors(n=220, dims=64, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * 0.2 + rng.uniform(-0.5, 0.5, (n, 1))
    x[40:60] = x[min(40, n - 1)]
    return [[i * 3, [float(v) for v in row]] for i, row in enumerate(x)]


def clustered(rows, k, rounds, seed):
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    start = sorted(((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in held))[:k]
    points = [v for _, v in start]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(points))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in held:
            groups[nearest(v)[1]].append(v)
        for j, g in groups.items():
            points[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *nearest(v)) for i, v in held]
    own = Counter()
    for _, d, j in found:
        own[j] += d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, j, d, own[j], sum(own.values()), digest[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("k", [8, 3])
def test_clusters(spark, k):
    rows = some_vectors()
    rows += [[None, rows[4][1]], rows[7], rows[7], [5000, [100_000.0, -100_000.0] + [0.25] * 62]]
    bad = [[9000, None], [9001, [1.0] * 63], [9002, [1.0] * 65], [9003, [None] + [1.0] * 63],
           [9004, [float("nan")] + [1.0] * 63], [9005, [float("-inf")] + [1.0] * 63], [9006, [1e300] + [1.0] * 63], [9007, []]]
    df = clashing(frame(spark, rows + bad, VECTORS)).withColumns({c: F.lit(1) for c in ("cluster", "distance", "v")})
    got = centroids.cluster(df, k, 10, 3)
    assert sorted(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                        "centroid_sha256").collect()), key=repr) == clustered(rows, k, 10, 3)


def test_few_vectors(spark):
    rows = some_vectors(5)
    assert sorted(map(tuple, centroids.cluster(frame(spark, rows, VECTORS)).collect()), key=repr) == clustered(
        rows, 8, 10, 3)
    assert centroids.cluster(frame(spark, [], VECTORS)).count() == 0
    assert centroids.cluster(frame(spark, [[1, None]], VECTORS)).count() == 0


@pytest.mark.parametrize("scale", [5, 300, 1 << 26])
def test_equal_average_search(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale + 1, (50, 64))
    points[20:25] = points[3]
    x = np.concatenate([rng.integers(-scale, scale + 1, (400, 64)), points]) // (1 + rng.integers(0, 3, (450, 1)))
    index = centroids.SortedCentroids(points)
    who, distance = index.nearest(x)
    exact = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (distance == exact.min(axis=1)).all() and (who == exact.argmin(axis=1)).all()


def test_equal_average_search_passes_over_most():
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (64, 64)) + rng.integers(-2000, 2000, (64, 1))
    x = points[rng.integers(0, 64, 1000)] + rng.integers(-20, 20, (1000, 64))
    index = centroids.SortedCentroids(points)
    index.nearest(x)
    assert index.compared < 0.1 * 64 * len(x)


# 13: mixture packing

def test_byte_tokens():
    rng = random.Random(1)
    plain = Tokenizer.from_file(BYTE_TOKENIZER)
    signs = list("ab é.,'st1²\n\n  \t\xa0 \x1c\x1f　ñ́ǅ€-!?😀 ") + ["'s", " 'll", "<|endoftext|>", "the", " it's"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice(["a", " b", " cd", "\n", " the.", "x y)"]) for _ in range(rng.randint(0, 30)))
              for _ in range(2000)]
    texts += ["x" * 5000, " " * 5000, "one\x00two \x00", "many " + " ".join(f"w{i}" for i in range(4000))]
    encoder = byte_tokens.ByteEncoder(BYTE_TOKENIZER)
    for _ in range(2):
        for at in range(0, len(texts), 50):
            part = texts[at:at + 50]
            for text, ids in zip(part, encoder.encode([t.encode() for t in part])):
                assert np.frombuffer(ids, encoder.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        byte_tokens.ByteEncoder(tokenizer_path("word_bpe_49k.json"))


def test_byte_tokens_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(byte_tokens, "TABLE_WORDS", 50)
    plain, encoder = Tokenizer.from_file(BYTE_TOKENIZER), byte_tokens.ByteEncoder(BYTE_TOKENIZER)
    rng = random.Random(3)
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice(["ab", "cde,", "f1", "é."]) + rng.choice("xyz") for _ in range(20)) for _ in range(3))
        assert np.frombuffer(encoder.encode([text.encode()])[0], encoder.dtype).tolist() == plain.encode(
            text, add_special_tokens=False).ids


def whole_packing(out, rows, capacity):
    """Checks that every id lies in one piece and sequences have no gaps; returns their lengths in order."""
    plain = Tokenizer.from_file(BYTE_TOKENIZER)
    ids = [[*plain.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for row, x in zip(rows, ids):
        want[row[0]].append(x)
    for doc, texts in want.items():
        pieces = sorted(((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc.pop(doc)))
        if len(texts) == 1:  # rows with one id cannot be told apart here
            at = 0
            for n, start, length, crc in pieces:
                assert (n, start) == (len(texts[0]), at) and length > 0
                assert crc == brute.crc(texts[0][start:start + length])
                at += length
            assert at == len(texts[0])
        else:
            assert sum(p[2] for p in pieces) == sum(map(len, texts))
    assert not by_doc
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for _, parts in sorted(sequences.items()):
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0  # nothing is padded
        lengths.append(end)
    assert sum(lengths) == sum(map(len, ids)) and all(n == capacity for n in lengths[:sum(lengths) // capacity])
    return lengths


@pytest.mark.parametrize(("window", "packet"), [(1024, 32), (64, 16), (1 << 17, 512)])
def test_mixture(spark, rows, window, packet):
    out = mixture.pack_mixture(clashing(frame(spark, rows)).drop("start", "length"), BYTE_TOKENIZER, 1, 256,
                               window=window, packet=packet).collect()
    whole_packing(out, rows, 256)


def test_mixture_of_few_and_many_sources(spark, rows):
    one = [[i, r[1], "en", None, 1] for i, r in enumerate(rows)]
    out = mixture.pack_mixture(frame(spark, one), BYTE_TOKENIZER, 1, 128, window=512, packet=64).collect()
    whole_packing(out, one, 128)
    many = [[i, r[1], "en", f"s{i}", 1] for i, r in enumerate(rows)] + [[900 + i, None, "en", f"t{i}", 0] for i in range(300)]
    out = mixture.pack_mixture(frame(spark, many), BYTE_TOKENIZER, 1, 128, window=512, packet=64).collect()
    whole_packing(out, many, 128)
    assert len({r["queue"] for r in out}) <= 8 + 8
    assert mixture.pack_mixture(frame(spark, []), BYTE_TOKENIZER, 1).count() == 0
    few = [[1, None, None, None, None], [2, "", None, None, None], [2, "", None, None, None]]
    assert whole_packing(mixture.pack_mixture(frame(spark, few), BYTE_TOKENIZER, 1).collect(), few, 2048) == [2, 1]


@pytest.mark.parametrize("targets", [None, {"big": 0.25, "mid": 0.5}])
def test_windows_hold_their_targets(spark, targets):
    rng = random.Random(4)
    count = {"big": 300, "mid": 120, "low": 60}
    rows = [[i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(rng.randint(1, 400))), "en", s, 1]
            for i, s in enumerate(s for s, n in count.items() for _ in range(n))]
    source = {r[0]: r[3] for r in rows}
    out = mixture.pack_mixture(frame(spark, rows, partitions=7), BYTE_TOKENIZER, 1, 256, targets, 4096, 64).collect()
    whole_packing(out, rows, 256)
    held, total = defaultdict(Counter), Counter()
    for r in out:
        held[r["round"]][source[r["doc_id"]]] += r["length"]
        total[source[r["doc_id"]]] += r["length"]
    share = {s: n / sum(total.values()) for s, n in total.items()} if targets is None else {**targets, "low": 0.25}
    sent, full = Counter(), 0
    for number in range(max(held)):
        if any(sent[s] + 4096 * share[s] + 128 > total[s] for s in share):
            break  # a queue runs dry
        full += 1
        for s in share:
            sent[s] += held[number][s]
            assert abs(held[number][s] - 4096 * share[s]) <= 64 + 1
            assert abs(sent[s] - 4096 * share[s] * (number + 1)) <= 64 + 1  # deficits do not add up
    assert full >= 5
    with pytest.raises(ValueError):
        mixture.pack_mixture(frame(spark, rows), BYTE_TOKENIZER, 1, targets={"big": 1.5})


def test_schedule_on_random_queues():
    rng = random.Random(9)
    for _ in range(200):
        totals = [rng.choice([1, 2, 7, 100, 1000, 5000]) for _ in range(rng.randint(1, 9))]
        shares = [rng.choice([1, 3, 50]) for _ in totals] if rng.random() < 0.5 else totals
        schedule = mixture.Schedule(totals, shares, rng.choice([16, 100, 999]), rng.choice([1, 8, 33]), 32)
        docs = []
        for q, n in enumerate(totals):
            at = 0
            while at < n:
                size = min(n - at, rng.randint(1, 300))
                docs.append((q, at, size))
                at += size
        doc, start, length, _, sequence, offset = schedule.pieces(*(np.array(c, np.int64) for c in zip(*docs)))
        taken = sorted((int(s), int(o), int(n)) for s, o, n in zip(sequence, offset, length))
        ends = Counter()
        for s, o, n in taken:
            assert ends[s] == o
            ends[s] += n
        assert sum(ends.values()) == sum(totals) and all(n == 32 or n & (n - 1) == 0 for n in ends.values())
        for i, (_, _, size) in enumerate(docs):
            assert sorted(zip(start[doc == i].tolist(), length[doc == i].tolist()))[0][0] == 0
            assert int(length[doc == i].sum()) == size
