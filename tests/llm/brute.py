"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(LOWER)


def deduped_lines(docs):
    """doc_id -> (text, n_lines, n_dropped)"""
    owner = {}
    for doc, text in sorted(docs.items()):
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 10:
                owner.setdefault(key, doc)
    out = {}
    for doc, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(lower(x.strip(SPACE)), doc) == doc]
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def shingles(text, size=5):
    words = [w for w in re.split(f"[{SPACE}]+", lower(text)) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar_groups(docs):
    """doc_id -> (set size, component)"""
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def contamination(docs, items):
    """doc_id -> (n_words, n_hit, sorted item ids)"""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = {}
    for doc, text in docs.items():
        w, hit, found = words(text), set(), set()
        for size in range(1, 11):
            for i in range(len(w) - size + 1):
                if (win := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[win]
        out[doc] = (len(w), len(hit), sorted(map(str, found)))
    return out


def quality_stats(text):
    text = text or ""
    w = [x for x in re.split(f"[{SPACE}]+", text) if x]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if times[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    marks = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), marks, len(lines) - len(set(lines)), len(inside)


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def pii_spans(text):
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, p) in enumerate(PII.items())
        for m in p.finditer(text or "")
        if accepted(kind, m.group())
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
