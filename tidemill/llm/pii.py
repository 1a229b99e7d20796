"""Personal data in texts: an Aho-Corasick automaton finds anchors, local parsers expand and check them.

Anchors are at-signs, plus signs, digits, scheme marks and words that announce an identifier. From
an anchor only its neighbourhood is read: the longest stretch in the kind's own alphabet. All work
is linear in the text.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone`` (the base), then ``url`` (with credentials,
or a query field that names a person or a key) and ``account`` (an identifier after its cue: IBAN
with right check digits, social security number, or a number or key with at least six characters
and four digits). Positions count code points, ends are exclusive; spans of one kind do not overlap.

Cases: null and empty texts have no spans. Every row gives one row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.rows import base_columns, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "customer id", "user id", "token",
        "password", "passwd", "secret", "api key", "api_key", "apikey")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
#: Begins where a run of digits does: a match from inside the run would be one from its start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
SPACED = re.compile(r"[0-9 -]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"://([^\s\"'<>/]+)([^\s\"'<>]*)")
SCHEME = re.compile(r"(?<![A-Za-z0-9])(https?|ftps?|sftp|ssh|git|jdbc|mongodb|redis|amqp|postgres(?:ql)?|mysql)$")
PERSONAL_FIELD = re.compile(r"[?&;](?:user|username|uid|email|e-mail|mail|phone|token|key|api_key|password|ssn)="
                            r"[^&;#]+", re.ASCII | re.IGNORECASE)
AFTER_CUE = re.compile(r"(?:[ \t]{0,2}(?:number|nr|no|id|is)\b\.?)?[ \t]{0,2}[:=#]?[ \t]{0,2}[\"']?", re.ASCII | re.IGNORECASE)
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NUMBER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{5,}")

Span = tuple[int, int, int]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def small_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """Identifier that begins after the cue's separators, if any."""
    begin = AFTER_CUE.match(text, at).end()
    if begin == at:
        return None
    if (m := IBAN.match(text, begin)) and iban(m[0]):
        return m.span()
    if m := SSN.match(text, begin):
        return m.span()
    if (m := NUMBER.match(text, begin)) and sum(c in "0123456789" for c in m[0]) >= 4:
        return m.span()
    return None


def spans_of(text: str) -> list[Span]:
    """(start, kind number, end), sorted."""
    low = text.lower()
    if len(low) != len(text):  # a character with a longer lower case: only A-Z then
        low = "".join(c.lower() if c.isascii() else c for c in text)
    spans: list[Span] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (what, width) in automaton().iter(low):
        at = last - width + 1
        if what == "digit":
            if at >= ip_end:
                ip_end = DOTTED.match(text, at).end()
                if ip_end - at >= 7:
                    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text, at, ip_end)
                              if all(map(small_number, m[0].split(".")))]
            if at >= card_end:
                card_end = SPACED.match(text, at).end()
                if card_end - at >= 14:
                    for m in CARD.finditer(text, at, card_end):
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            spans.append((m.start(), 2, m.end()))
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append((start, 0, email_end))
        elif what == "plus":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append((at, 3, phone_end))
        elif what == "scheme":
            if at >= url_end and (s := SCHEME.search(text, max(url_end, at - 12), at)) and (m := URL.match(text, at)):
                url_end = m.end()
                user, sign, _ = m[1].rpartition("@")
                if sign and ":" in user or PERSONAL_FIELD.search(m[2]):
                    spans.append((s.start(), 4, url_end))
        elif at >= account_end and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            if found := account_after(text, last + 1):
                account_end = found[1]
                spans.append((found[0], 5, found[1]))
    spans.sort()
    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_url long, n_account long")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans as text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, all_spans = [], []
            for raw in texts:
                spans = spans_of(raw.decode("utf-8", "replace"))
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in spans))
                digests.append(hashlib.sha256(joined([s for s in spans if s[1] < len(BASE)]).encode()).hexdigest())
                all_spans.append(joined(spans))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), *n[:4], pa.array(digests, pa.string()),
                 pa.array(all_spans, pa.string()), *n[4:]],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account"])

    return base_columns(docs, doc_id=doc_id, text=text).mapInArrow(find, RESULT)
