"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shingle_components(docs, n_words, percent):
    """{place in docs: (number of shingles, least doc_id of the component, its number)}."""
    sets = []
    for _, text in docs:
        w = words((text or "").translate(LOW))
        sets.append({tuple(w[i:i + n_words]) for i in range(len(w) - n_words + 1)} if len(w) >= n_words
                    else ({tuple(w)} if w else set()))
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= percent * (len(a) + len(sets[j]) - shared) and shared:
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[root(i)].append(i)
    out = {}
    for r, who in members.items():
        ids = [docs[i][0] for i in who if docs[i][0] is not None]
        for i in who:
            out[i] = (len(sets[i]), min(ids) if ids and sets[i] else docs[i][0], r)
    return out


def quality(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def line_words(text):
    return {" ".join(words(x.translate(LOW))): len(words(x)) * 0 for x in (text or "").split("\n") if words(x)}


def repeats(docs, window):
    """Per (doc_id, text): words, removed words, checksum of the rest; docs in order."""
    seen, out = {}, {}
    for place, (doc, text) in enumerate(docs):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i:i + window]), (place, i)) != (place, i):
                gone[i:i + window] = [True] * window
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc, text] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
