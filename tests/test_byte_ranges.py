"""Lines by ranges of bytes: the same lines, places and numbers wherever files are cut."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemill.operators.select import limit_examples
from tidemill.operators.split import train_test_split
from tidemill.plans.order import by_id
from tidemill.sources import byte_ranges as br
from tidemill.sources.examples import read_keyed_examples
from tidemill.streaming import runs


def plain_lines(text: bytes):
    """(start, end, value) of every line."""
    out, at = [], 0
    for piece in text.split(b"\n"):
        end = min(len(text), at + len(piece) + 1)
        if end > at:
            out.append((at, end, piece))
        at = end
    return out


def some_text(seed, lines=40):
    rng = random.Random(seed)
    text = b"".join(bytes(rng.choice([97, 98, 195]) if rng.random() < 0.9 else 32 for _ in range(0)) +
                    "é".join(rng.choice(["", "ab", "c" * rng.randint(0, 60), "ß€"]) for _ in range(rng.randint(1, 4))).encode()
                    + b"\n" for _ in range(lines))
    return text if seed % 2 else text + b"no end"


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 1 << 20])
def test_every_line_comes_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(br, "MOST_RANGES", 1 << 60)
    monkeypatch.setattr(br, "BLOCK", 16)
    monkeypatch.setattr(br, "LOOK_BACK", 3)
    for seed in range(6):
        text = [b"", b"\n", b"\n\n", b"x", b"long " * 50, some_text(seed)][seed]
        path = tmp_path / f"{seed}-{size}.log"
        path.write_bytes(text)
        for begin in (0, 1, 5, len(text) // 2, max(0, len(text) - 1)):
            got, counted = [], []
            for part in br.cut(br.list_files(str(path)), size, begin):
                for batch in br.read_lines(part, unfinished=True):
                    got += [(r["start_byte"], r["end_byte"], r["value"]) for r in batch.to_pylist()]
            want = []
            for start, end, value in plain_lines(text):
                if end > begin:
                    at = max(start, begin)
                    rest = value[at - start:]
                    skip = br.whole_character(rest) if at == begin > 0 else 0
                    want.append((at + skip, end, rest[skip:].decode()))
            assert got == want, (seed, size, begin)
            counted = [br.count_lines(p) for p in br.cut(br.list_files(str(path)), size)]
            assert sum(counted) == len(plain_lines(text))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    texts = {"b.log": some_text(1, 300), "a/one.log": some_text(2, 10), "a/empty.log": b"", "c.log": b"last",
             ".hidden": b"no\n", "d.log.gz": some_text(3, 20), "e.log": b"bad \xff\xfe byte\nok\n"}
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(gzip.compress(text) if name.endswith(".gz") else text)
    return root, {str(root / n): t for n, t in texts.items() if n != ".hidden"}


@pytest.mark.parametrize("size", [900, 1 << 20])
def test_numbers_do_not_depend_on_ranges(spark, folder, size):
    root, texts = folder
    want, row = [], 0
    for name in sorted(texts):
        for no, (start, end, value) in enumerate(plain_lines(texts[name])):
            want.append((name, row, no, start, end, value.decode("utf-8", "replace")))
            row += 1
    got = br.read_numbered(spark, str(root), range_bytes=size)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    later = br.read_numbered(spark, str(root), "b.log", 700, size).orderBy("row_id").collect()
    assert (later[-1]["end_byte"], later[0]["start_byte"] >= 700) == (len(texts[str(root / "b.log")]), True)
    by_start = {w[3]: w[2] for w in want if w[0].endswith("/b.log")}
    assert [r["line_no"] for r in later[1:]] == [by_start[r["start_byte"]] for r in later[1:]]
    assert {r["file"] for r in br.files_out_of_range(spark, str(root), 4).collect()} == {
        str(root / "a/empty.log"), str(root / "c.log")}
    with pytest.raises(Exception, match="nowhere"):
        br.read_numbered(spark, str(root / "nowhere")).collect()


def test_a_stream_follows_growing_files(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    root.mkdir()
    run = lambda: runs.run_to_files(br.stream_lines(spark, str(root), range_bytes=9), out, checkpoint)
    got = lambda: sorted((r["file"].rsplit("/", 1)[1], r["start_byte"], r["value"])
                         for r in spark.read.parquet(out).collect())
    (root / "a.log").write_bytes("first\nsecönd\nhalf".encode())
    run()
    assert got() == [("a.log", 0, "first"), ("a.log", 6, "secönd")]
    run()  # nothing new
    assert len(got()) == 2
    with open(root / "a.log", "ab") as file:
        file.write(b" a line\nmore\n")
    (root / "b.log").write_bytes(b"\nother file, longer than a range\n")
    run()
    assert got() == [("a.log", 0, "first"), ("a.log", 6, "secönd"), ("a.log", 14, "half a line"), ("a.log", 26, "more"),
                     ("b.log", 0, ""), ("b.log", 1, "other file, longer than a range")]
    (root / "b.log").write_bytes(b"cut\n")
    with pytest.raises(Exception, match="were read before"):
        run()


def test_written_lines_are_read_back(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"line {i}") for i in range(100)]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, value string").repartition(7)
    for upto in (50, 100):  # the second time whole files are replaced
        br.write_lines(lines.where(f"line_no < {upto}"), str(tmp_path / "out"))
    got = br.read_numbered(spark, str(tmp_path / "out"), range_bytes=512).orderBy("row_id").collect()
    want = [v for f in ("f0", "f1", "f2") for n, i, v in rows if n == f]
    assert [r["value"] for r in got] == want and [r["row_id"] for r in got] == list(range(100))


EXAMPLE = StructType([StructField("text", StringType()), StructField("n", LongType()), StructField("split", StringType())])


def test_equal_json_rows_have_keys(spark, tmp_path):
    for name, n in (("x.jsonl", 30), ("y.jsonl", 17)):
        rows = [json.dumps({"text": "same", "n": i % 2, "split": "train" if i % 5 else "test"}) for i in range(n)]
        (tmp_path / name).write_text("\n\n".join(rows) + ("\nnot json" if n == 17 else ""))
    kept = []
    for size in (700, 1 << 20):
        rows = read_keyed_examples(spark, str(tmp_path), EXAMPLE, None, "*.jsonl", size)
        assert rows.count() == 48 and rows.select("row_id").distinct().count() == 48
        few = limit_examples(rows, 11, by_id("row_id"))
        assert few.count() == 11
        halves = train_test_split(rows, ["row_id"], 0.5)
        assert halves.where("split = 'test'").count() == 24
        kept.append((sorted(map(tuple, few.collect())), sorted(map(str, halves.collect()))))
    assert kept[0] == kept[1]
    assert read_keyed_examples(spark, str(tmp_path), EXAMPLE, "train", "x.jsonl").count() == 24
    with pytest.raises(ValueError, match="row_id"):
        read_keyed_examples(spark, str(tmp_path), StructType([StructField("row_id", LongType())]))


def test_many_short_files_are_few_tasks(spark, tmp_path, monkeypatch):
    """A task reads many short ranges, batch and stream alike; a long range is a task of its own."""
    for i in range(300):
        (tmp_path / f"{i:03}.log").write_text("".join(f"{i} {j}\n" for j in range(i % 40)))
    assert br._read(spark, "lines", str(tmp_path), "*", 16).rdd.getNumPartitions() <= 3
    lines = br.read_numbered(spark, str(tmp_path), range_bytes=16).orderBy("row_id").collect()
    want = [(i, j) for i in range(300) for j in range(i % 40)]
    assert [(r["row_id"], r["line_no"], r["value"]) for r in lines] == [
        (n, j, f"{i} {j}") for n, (i, j) in enumerate(want)]
    growing = br.GrowingFiles(str(tmp_path), "*", 16)
    parts = growing.partitions({}, growing.latestOffset())
    assert len(parts) <= 3 and sum(b.num_rows for p in parts for b in growing.read(p)) == len(want)
    monkeypatch.setattr(br, "TASK_BYTES", 1 << 20)
    long = [br.Range("a", n, n << 20, n + 1 << 20, 0, False) for n in range(3)]
    assert [t.ranges for t in br.tasks(long)] == [(r,) for r in long]
