from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    """Documents with copies, near copies, shared passages and lines, and awkward rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéoß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line = some(45), " ".join(some(12))
    rows, base = [], []
    for i in range(n):
        w = some(rng.randint(5, 120))
        if i % 5 == 1:
            at = rng.randrange(len(w))
            w = w[:at] + passage + w[at:]
        if i % 7 == 2 and base:
            w = list(rng.choice(base))
            if i % 2:
                w[rng.randrange(len(w))] = "changed"
        base.append(w)
        text = " ".join(w)
        if i % 3 == 0:
            cut = rng.randrange(len(text))
            text = text[:cut] + "\n" + line + ("x" if i % 2 else "") + "\n" + text[cut:]
        rows.append([1000 + i, text, "en", f"s{i % 3}", len(text)])
    return rows


AWKWARD = [
    [1, None, None, None, None], [2, "", "en", "s0", 0], [3, " \n\t ", "en", "s0", 4],
    [4, "one", "en", "s1", 3], [5, "One", "en", "s1", 3], [6, "a b c", "en", None, 5], [7, "A  b\nC", "en", None, 6],
    [None, "nobody owns this text of a few words which is long enough to be a line", "de", "s1", 9],
    [9, "same row", "en", "s1", 8], [9, "same row", "en", "s1", 8], [10, "x y z w " * 40, "en", "s2", 320],
    [11, "x y z w " * 40, "en", "s2", 320], [12, "#*$%&|<>" * 3 + "é" * 30, "fr", "s2", 54],
    [13, " ".join(f"long{i % 997}" for i in range(30_000)), "en", "s2", 1],
]
#: Names that the operators use inside.
CLASHES = ["row", "id", "th", "key", "line", "first", "place", "copy", "n", "cid", "list", "vector", "rank", "doc",
           "nth", "kept", "host", "kept_id", "at", "made", "lines", "n_lines", "piece", "start", "length", "s", "rate"]


def frame(spark, rows, schema=DOCUMENTS, partitions=5):
    return spark.createDataFrame(rows, schema).repartition(partitions)


def clashing(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def rows():
    return corpus() + AWKWARD


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()
