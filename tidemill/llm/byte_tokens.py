"""Token ids of whole texts from a byte-level tokenizer file, piece by piece with a table per worker.

The tokenizer's own pattern ends a piece where a run of letters or other signs meets white space, and
gives the last space before a word to that word. So a text may be cut in front of every space that is
followed by something else than white space, and around line ends that do not stand in longer runs of white
space; the ids of its words, one after another, are those of the whole text. Texts with other white space are
cut by a pattern that only cuts where the tokenizer does; those with the name of a special token go to the
tokenizer whole.
:func:`check_byte_level` refuses other kinds of files.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import product

import numpy as np
from tokenizers import AddedToken, Tokenizer

from tidemill.llm.rows import KNOWN_WORD_BYTES
from tidemill.llm.tokens import BYTE_SIGNS, TABLE_WORDS, WORDS_PER_TEXT

#: White space as the tokenizer's pattern has it (of Unicode), and letters that need no table.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PIECE = re.compile(f" ?[{LETTERS}]++(?=[{SPACE}.,;:!?]|\\Z)| ?[^{SPACE}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: One run of letters and perhaps one of signs after it: two pieces for the tokenizer.
PLAIN = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])++)"
                   rb"([.,;:!?)]*+)")
#: Not part of any UTF-8 text.
CUT = b"\xff"
#: White space that is not cut at every sign: other than spaces and line ends, three in a row, two at the end of a text.
OTHER = [c.encode() for c in re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))) if c not in " \n"]
RUNS = [bytes(x) for x in product(b" \n", repeat=3)] + [c for c in OTHER if c[:2] != b"\xe2\x80"]
WIDE = re.compile(b"|".join(c for c in OTHER if c[:2] == b"\xe2\x80"))
ENDS = tuple(bytes(x) for x in product(b" \n", repeat=2))


def has_runs(text: bytes) -> bool:
    return any(x in text for x in RUNS) or b"\xe2\x80" in text and WIDE.search(text) is not None


def check_byte_level(path: str) -> int:
    """Number of ids of the tokenizer; raises if its pieces are not those of ``PIECE``."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    cut = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex") \
            or cut.get("add_prefix_space"):
        raise ValueError(f"{path}: this tokenizer is not byte-level with the usual pattern")
    return max([*parts["model"]["vocab"].values(), *(t["id"] for t in parts.get("added_tokens", []))]) + 1


class ByteEncoder:
    """Ids as little-endian unsigned bytes, two per id where all ids fit, else four."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.dtype = np.dtype("<u2") if check_byte_level(path) < 1 << 16 else np.dtype("<u4")
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        # a piece with other signs than white space holds no line end, so as a token of its own it keeps pieces apart
        self.lines = Tokenizer.from_file(path)
        self.lines.add_special_tokens([AddedToken("\n", normalized=False, special=True)])
        self.line_end = self.lines.token_to_id("\n")
        # words met lately, and those met before them: what is met again moves on
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.model = self.whole.model
        self.few: dict[bytes, bytes] = {}

    def as_bytes(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without line ends."""
        texts = ["\n".join(pieces[i:i + WORDS_PER_TEXT]) for i in range(0, len(pieces), WORDS_PER_TEXT)]
        out, width = [], self.dtype.itemsize
        for start in range(0, len(texts), 64):
            for found in self.lines.encode_batch_fast(texts[start:start + 64], add_special_tokens=False):
                ids = found.ids
                flat, at = self.as_bytes(ids), 0
                for _ in range(ids.count(self.line_end)):
                    end = ids.index(self.line_end, at)
                    out.append(flat[at * width:end * width])
                    at = end + 1
                out.append(flat[at * width:])
        return out

    def learn(self, words: set[bytes]) -> None:
        """Enter words into the table."""
        if len(self.young) + 2 * len(words) > TABLE_WORDS:
            self.old, self.young = self.young, {}
        table, old, rest = self.young, self.old, []
        for word in words:
            if word in table:  # as the letters of another one
                continue
            ids = old.get(word)
            if ids is None:
                plain = PLAIN.fullmatch(word)
                if plain is None:
                    if word in (b" ", b"\n"):
                        table[word] = self.signs(word)
                    else:
                        rest.append(word)
                    continue
                letters, signs = plain.groups()
                ids = table.get(letters)
                if ids is None:
                    ids = old.get(letters) or self.letters(letters)
                    if len(letters) <= KNOWN_WORD_BYTES:
                        table[letters] = ids
                if signs:
                    ids += self.signs(signs)
            table[word] = ids
        table.update(zip(rest, self.new_pieces([w.decode() for w in rest]), strict=True))

    def letters(self, word: bytes) -> bytes:
        """Ids of one run of letters, with or without a space before it."""
        return self.as_bytes([t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_SIGNS))])

    def signs(self, signs: bytes) -> bytes:
        if signs not in self.few:
            if len(self.few) > 10_000:
                self.few.clear()
            self.few[signs] = self.as_bytes(self.whole.encode(signs.decode(), add_special_tokens=False).ids)
        return self.few[signs]

    def by_piece(self, text: str) -> bytes:
        """Ids of a text with any white space."""
        pieces = PIECE.findall(text)
        known = {p: None for p in pieces}
        plain = [p for p in known if "\n" not in p]
        known.update(zip(plain, self.new_pieces(plain), strict=True))
        for p in known:
            if known[p] is None:  # white space
                known[p] = self.as_bytes(self.whole.encode(p, add_special_tokens=False).ids)
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        together = CUT.join(texts)
        special, strange = any(name in together for name in self.special), has_runs(together)
        out: list[bytes | None] = [None] * len(texts)
        words: dict[int, list[bytes]] = {}
        for i, text in enumerate(texts):
            if special and any(name in text for name in self.special):
                out[i] = self.as_bytes(self.whole.encode(text.decode(), add_special_tokens=False).ids)
            elif text.endswith(ENDS) or strange and has_runs(text):
                out[i] = self.by_piece(text.decode())
            else:
                words[i] = text.replace(b" ", CUT + b" ").replace(b"\n", CUT + b"\n" + CUT).split(CUT)
        found = {i: list(map(self.young.get, w)) for i, w in words.items()}
        partly = [i for i, ids in found.items() if None in ids]
        missing = {x for i in partly for x, ids in zip(words[i], found[i]) if ids is None}
        if missing:
            self.learn(missing)
        for i in partly:
            found[i] = [self.young[x] if ids is None else ids for x, ids in zip(words[i], found[i])]
        for i, ids in found.items():
            out[i] = b"".join(ids)
        for word in missing:
            if len(word) > KNOWN_WORD_BYTES:
                self.young.pop(word, None)
        return out


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One per worker process and tokenizer file."""
    return ByteEncoder(path)
