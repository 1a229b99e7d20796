"""Token ids of whole texts from a tokenizer file, word by word with a word table per worker.

Texts are cut at ASCII white space only. That gives the ids of the whole text for tokenizers whose
pre-tokenizer ends every piece at white space and drops it, and whose normalizer does not join
characters across it; :func:`check_word_wise` refuses a tokenizer file that does not say so.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import AddedToken, Tokenizer

from tidemill.llm.rows import KNOWN_WORD_BYTES

#: Words in each half of a worker's word table (some 200 bytes each).
TABLE_WORDS = 600_000
#: Places (of a byte each) that tell whether a word was met before; they are emptied when a quarter is taken.
MET_PLACES = 1 << 22

#: New words given to the tokenizer as one text, one word a line.
WORDS_PER_TEXT = 20

#: How a byte is written in the vocabulary: as itself if it prints, else as the next character from 256 on.
PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b if b in PRINTS else 256 + i for i, b in enumerate(
    [*(b for b in range(256) if b not in PRINTS), *PRINTS])}

#: A run of lower-case letters that no normalizer changes and perhaps one of signs after it, cut in between by this pattern.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])++)([.,;:!?]*+)")
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Normalizers and pre-tokenizers that work on each white-space free piece alone.
WORD_WISE = {"NFC", "NFD", "NFKC", "NFKD", "Replace", "Lowercase", "Split", "ByteLevel"}


def check_word_wise(path: str) -> tuple[int, bool, bool]:
    """Number of ids of the tokenizer, whether it lower-cases, and whether ``PLAIN`` words go to its model in two parts.

    Raises if its ids could depend on more than one word.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    steps = []
    for kind, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        part = parts.get(kind) or {}
        steps += part.get(inner, [part] if part else [])
    # lower-casing first changes nothing if no step before it tells cases apart
    kinds = [s["type"] for s in steps]
    before = steps[:kinds.index("Lowercase")] if "Lowercase" in kinds else None
    lowers = before is not None and all(
        s["type"] in ("NFC", "NFD", "NFKC", "NFKD")
        or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in before)
    drops = any(s["type"] == "Split" and s.get("behavior") == "Removed" and s.get("invert")
                and r"[^\s" in s["pattern"].get("Regex", "") for s in steps)
    if not drops or any(s["type"] not in WORD_WISE for s in steps) or any(
            s.get("add_prefix_space") or s.get("use_regex") for s in steps if s["type"] == "ByteLevel"):
        raise ValueError(f"{path}: this tokenizer does not work word by word")
    ids = list(parts["model"]["vocab"].values()) + [t["id"] for t in parts.get("added_tokens", [])]
    split = [s for s in steps if s["type"] == "Split"]
    plain = (all(s["type"] in ("NFC", "Lowercase", "Split", "ByteLevel")
                 or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
             and [s["pattern"] for s in split] == [{"Regex": LETTERS_APART}] and kinds[-1] == "ByteLevel"
             and parts["model"]["type"] == "BPE" and not any(
                 re.search("[a-zß-öø-ÿ.,;:!?]", t["content"]) and re.fullmatch("[a-zß-öø-ÿ.,;:!?]+", t["content"])
                 for t in parts.get("added_tokens", [])))
    return max(ids) + 1, lowers, plain


class Encoder:
    """Ids as little-endian unsigned bytes, two per id where all ids fit, else four."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        self.table_words = table_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        size, self.lowers, self.plain = check_word_wise(path)
        self.dtype = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # their names are looked for in the text as it is
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # no word holds a line end, so as a token of its own it keeps the words of one text apart
        self.tokenizer.add_special_tokens([AddedToken("\n", normalized=False, special=True)])
        self.line_end = self.tokenizer.token_to_id("\n")
        # words met lately, and those met before them: what is met again moves on
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.few: dict[bytes, bytes] = {}
        # a word enters the table when it is met again: most new words are never
        self.met, self.n_met = bytearray(MET_PLACES), 0

    def met_before(self, word: bytes) -> bool:
        """Whether the word was met in an earlier call (seldom, another word with the same place)."""
        place = hash(word) & (MET_PLACES - 1)
        if self.met[place]:
            return True
        if 4 * self.n_met > MET_PLACES:
            self.met, self.n_met = bytearray(MET_PLACES), 0
        self.met[place] = 1
        self.n_met += 1
        return False

    def plain_words(self, words: list[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
        """Ids of plain words, whose letters the model takes without the steps before it; and the other words."""
        found, rest = {}, []
        for word in words:
            plain = PLAIN.fullmatch(word)
            if plain is None:
                rest.append(word)
                continue
            letters, signs = plain.groups()
            ids = found.get(letters) or self.young.get(letters) or self.old.get(letters) or self.letters(letters)
            found[word] = ids + self.signs(signs) if signs else ids
        return found, rest

    def letters(self, word: bytes) -> bytes:
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_SIGNS)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(text)]).tobytes()

    def signs(self, signs: bytes) -> bytes:
        if signs not in self.few:
            if len(self.few) > 10_000:
                self.few.clear()
            self.few[signs] = self.new_words([signs])[0]
        return self.few[signs]

    def new_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are in no table."""
        texts = ["\n".join(w.decode("utf-8", "replace") for w in words[i:i + WORDS_PER_TEXT])
                 for i in range(0, len(words), WORDS_PER_TEXT)]
        out, width = [], self.dtype.itemsize
        for start in range(0, len(texts), 64):
            for found in self.tokenizer.encode_batch_fast(texts[start:start + 64], add_special_tokens=False):
                ids = found.ids
                flat, at = array(self.dtype.char, ids).tobytes(), 0
                for _ in range(ids.count(self.line_end)):
                    end = ids.index(self.line_end, at)
                    out.append(flat[at * width:end * width])
                    at = end + 1
                out.append(flat[at * width:])
        return out

    def words(self, text: bytes) -> list[bytes]:
        if self.lowers:
            lower = text.lower()
            if not any(name in lower for name in self.special):
                return lower.split()
        return text.split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [self.words(t) for t in texts]
        met = set().union(*words) if words else set()
        if len(self.young) + len(met) > self.table_words:
            self.old, self.young = self.young, {}
        table, old = self.young, self.old
        new = []
        for word in met.difference(table):
            ids = old.get(word)
            if ids is None:
                new.append(word)
            else:
                table[word] = ids
        found, rest = self.plain_words(new) if self.plain else ({}, new)
        table.update(found)
        table.update(zip(rest, self.new_words(rest), strict=True))
        out = [b"".join(map(table.__getitem__, w)) for w in words]
        for word in new:
            if len(word) > KNOWN_WORD_BYTES or not self.met_before(word):
                del table[word]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, table_words: int = TABLE_WORDS) -> Encoder:
    """One per worker process, tokenizer file and size of the word table."""
    return Encoder(path, table_words)


def forget() -> None:
    """Give back what this worker process remembers, before it goes on to other work."""
    encoder.cache_clear()
