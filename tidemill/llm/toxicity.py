"""Toxicity scores from a learned lexicon, matched with Levenshtein automata, and the words around a match.

The lexicon is learned from labelled documents: words with many different left neighbours in toxic
ones and few in clean ones (neighbours, so that copies of one document count once). It is held as a
trie. A word that is not in it is read as a Levenshtein automaton, which accepts all terms within one
edit, and intersected with the trie: both are walked together, and a branch ends where the automaton
has no state left. Words that occur in clean documents themselves are no misspellings.

A match is a quotation if quotation marks enclose it within ``REACH`` words or a reporting word stands
there; otherwise it is abuse. A logistic regression on counts of both kinds gives the score.

Learning takes at most about ``SAMPLE`` labelled rows, chosen by hash; the lexicon has at most
``TERMS`` terms and ``NEIGHBOURS`` clean words near them. Scoring reads every whole text.

Cases: null and empty texts have no matches and get the score of a text without any. Without
toxic or without clean labels in the learning part every score is the share of toxic ones (0 without
labels). A null doc_id is hashed as the word ``null``. Every row gives one row. Several labels of one
document count as toxic if one is. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.rows import KNOWN_WORD_BYTES, KNOWN_WORDS, base_columns, slices
from tidemill.session import stage

SAMPLE = 16_000
FOLDS = 5
#: Left neighbours in toxic documents that a term has at least, and how much likelier it is there.
CONTEXTS = 4
ODDS = 20.0
TERMS = 2_000
NEIGHBOURS = 20_000
#: Shorter terms have to match exactly.
FUZZY_LENGTH = 5
REACH = 6
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
REPORTING = frozenset((
    "said says say wrote writes quoted quote quotes quoting reported reports called calls termed word words term "
    "dit disait écrit mot cité sagte schrieb zitat wort dijo escribió palabra citado").split())
#: Characters that stand for letters.
STAND_INS = str.maketrans("0134578@$!", "oieastbasi")


def plain(word: str) -> str:
    """Lower case, without marks around the word; characters that stand for letters inside it replaced."""
    word = word.lower().strip("\"'“”„«»‹›‘’.,;:!?()[]{}*#%&|<>=-_~`/\\")
    return word if word.isalpha() else word.translate(STAND_INS)


class Automaton:
    """Levenshtein automaton of a word for at most one edit.

    A state is the set of (letters read, edits made) that are possible, as two bit sets of places in
    the word: without an edit, and with one.
    """

    def __init__(self, word: str):
        self.size = len(word)
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def start(self) -> tuple[int, int]:
        return 1, 2 if self.size else 0

    def step(self, state: tuple[int, int], letter: str) -> tuple[int, int]:
        exact, edited = state
        here = self.places.get(letter, 0)
        limit = (2 << self.size) - 1
        same = (exact & here) << 1
        # an edit: the letter is extra, replaces one, or one of the word's was left out after a match
        one = (edited & here) << 1 | exact | exact << 1 | same << 1
        return same & limit, one & limit

    def accepts(self, state: tuple[int, int]) -> bool:
        return bool((state[0] | state[1]) >> self.size & 1)


class Lexicon:
    """Terms as a trie, with the clean words that are within one edit of a term."""

    def __init__(self, terms: list[str], clean: set[str] = frozenset()):
        self.terms, self.clean = set(terms), clean
        self.trie: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term in terms:
            if len(term) < FUZZY_LENGTH:
                continue
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            half = len(term) // 2
            self.heads.add(term[:half])
            self.tails.add(term[half:])
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(t) for t in self.tails})
        self.longest = max((len(t) for t in terms), default=0)

    def near(self, word: str) -> str | None:
        """A term within one edit, the least by alphabet; one half of it stands in the word unchanged."""
        if not FUZZY_LENGTH - 1 <= len(word) <= self.longest + 1 or not (
                any(word[:n] in self.heads for n in self.head_sizes)
                or any(word[-n:] in self.tails for n in self.tail_sizes)):
            return None
        automaton = Automaton(word)
        found = None
        stack = [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if not letter:
                    if automaton.accepts(state) and (found is None or child < found):
                        found = child
                    continue
                after = automaton.step(state, letter)
                if after != (0, 0):
                    stack.append((child, after))
        return found

    def match(self, word: str) -> tuple[str, bool] | None:
        """The term that ``word`` is or misspells, and whether it is misspelled."""
        word = plain(word)
        if word in self.terms:
            return word, False
        if not word or word in self.clean:
            return None
        term = self.near(word)
        return (term, True) if term else None


class Matches(dict):
    """Match of each word as met, forgetful."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes):
        value = self.lexicon.match(word.decode("utf-8", "replace"))
        if len(word) <= KNOWN_WORD_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


def is_quoted(words: list[bytes], at: int) -> bool:
    """Whether the match at ``at`` is reported rather than said."""
    before = [w.decode("utf-8", "replace") for w in words[max(0, at - REACH):at]]
    after = [w.decode("utf-8", "replace") for w in words[at + 1:at + 1 + REACH]]
    own = words[at].decode("utf-8", "replace")
    opened = own[0] in OPENING or any(w[0] in OPENING for w in before)
    closed = own.rstrip(".,;:!?")[-1:] in CLOSING if len(own) > 1 else False
    closed = closed or any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in CLOSING for w in after)
    return opened and closed or any(plain(w) in REPORTING for w in before)


def features(text: bytes, matches: Matches) -> list[float]:
    words = text.split()
    hits = [i for i, m in enumerate(map(matches.__getitem__, words)) if m]
    abuse = fuzzy = quoted = 0
    terms = set()
    for i in hits:
        term, misspelled = matches[words[i]]
        if is_quoted(words, i):
            quoted += 1
            continue
        abuse, fuzzy = abuse + (not misspelled), fuzzy + misspelled
        terms.add(term)
    return [math.log1p(abuse), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len(terms)),
            10 * (abuse + fuzzy) / (len(words) + 20)]


N_FEATURES = 5


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression, bias first, by Newton steps with a small penalty."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    ridge = penalty * len(x) / 100 * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS


def sampled(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Texts with labels to learn from: at most about ``size``, none of the held-out fold."""
    known = (labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, size / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.filter(place < int(share * (1 << 30))).withColumnRenamed("doc_id", "labelled").limit(2 * size)
    texts = base_columns(docs, doc_id="doc_id", text="text")
    return stage(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # bounded by the sample
                 .select("doc_id", "toxic", "text"), "toxicity-sample")


def learn_lexicon(sample: DataFrame) -> Lexicon:
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words_out, toxic_out, left_out = [], [], []
            for toxic, text in zip(batch.column(1).to_pylist(), texts):
                words = [plain(w.decode("utf-8", "replace")) for w in text.split()]
                for word, left in {(w, left) for w, left in zip(words, ["", *words]) if 3 <= len(w) <= 40}:
                    words_out.append(word)
                    toxic_out.append(bool(toxic))
                    left_out.append(left[:40])
            yield pa.record_batch([pa.array(words_out, pa.string()), pa.array(toxic_out, pa.bool_()),
                                   pa.array(left_out, pa.string())], names=["word", "toxic", "left"])

    met = (sample.select("doc_id", "toxic", "text").mapInArrow(contexts, "word string, toxic boolean, left string")
           .select("word", "toxic", F.xxhash64("left").alias("left")).distinct()
           .groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")))
    met = stage(met, "contexts")
    sums = met.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not sums["t"] or not sums["c"]:
        return Lexicon([])
    odds = (F.col("t") + 0.5) / (F.col("c") + 0.5) * (sums["c"] / sums["t"])
    chosen = met.filter((F.col("t") >= CONTEXTS) & (odds >= ODDS)).orderBy(F.desc(odds), "word").limit(TERMS)
    terms = [r["word"] for r in chosen.select("word").collect()]
    lexicon = Lexicon(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.near(w) is not None and w not in lexicon.terms
                                         for w in batch.column(0).to_pylist()], pa.bool_()))

    clean = met.filter((F.col("c") > 0) & (odds < 1.0)).select("word", "c").mapInArrow(near, "word string, c long")
    return Lexicon(terms, {r["word"] for r in clean.orderBy(F.desc("c"), "word").limit(NEIGHBOURS).collect()})


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Columns doc_id, held_out, score, predicted: a row per document."""
    learning = sampled(docs, labels, sample)
    lexicon = learn_lexicon(learning)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(lexicon)
        for batch, texts in slices(batches):
            values = [features(t, matches) for t in texts]
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array(values, pa.list_(pa.float64()))],
                                  names=["toxic", "x"])

    # bounded by the sample: six numbers a row
    rows = learning.select("doc_id", "toxic", "text").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    y = rows.column("toxic").to_numpy().astype(float) > 0
    if y.any() and not y.all():
        weights = fit(np.stack(rows.column("x").to_pylist()), y.astype(float))
    else:
        weights = np.array([30.0 if len(y) and y.all() else -30.0] + [0.0] * N_FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(lexicon)
        for batch, texts in slices(batches):
            x = np.array([[1.0, *features(t, matches)] for t in texts]).reshape(len(texts), N_FEATURES + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(p)], names=["doc_id", "score"])

    scored = base_columns(docs, doc_id="doc_id", text="text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
