"""The contracts, row by row in plain Python."""

import hashlib
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def contamination(rows, items):
    windows = {}
    for item, text in items:
        w = WORDS.findall(lower(text))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        w = WORDS.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(rows, split, length=50):
    """(doc_id, units, covered) of each row."""
    first = {}
    cut = [(doc_id, split(text)) for doc_id, text in rows]
    for doc_id, u in cut:
        if doc_id is not None:
            for k in range(len(u) - length + 1):
                w = tuple(u[k : k + length])
                first[w] = min(first.get(w, doc_id), doc_id)
    for doc_id, u in cut:
        covered = [False] * len(u)
        if doc_id is not None:
            for k in range(len(u) - length + 1):
                if first[tuple(u[k : k + length])] < doc_id:
                    covered[k : k + length] = [True] * length
        yield doc_id, u, covered


def repeated_words(rows):
    return [(d, len(u), sum(c), hashlib.sha256(b" ".join(x for x, y in zip(u, c, strict=True) if not y)).hexdigest()) for d, u, c in repeats(rows, lambda t: (t or "").encode().split())]


def repeated_bytes(rows):
    out = []
    for d, u, c in repeats(rows, lambda t: (t or "").encode()):
        spans = sum(1 for k, x in enumerate(c) if x and not (k and c[k - 1]))
        out.append((d, len(u), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(u, c, strict=True) if not y)).hexdigest()))
    return out


def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(rows):
    """(doc_id, size, component, kept) of each row; rows of an id are one document."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    at = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g] if j < i).items():
            e, other = sets[j]
            if d is not None and e is not None and 100 * n >= 75 * (len(s) + len(other) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return [(d, len(s), (root(d) if s else d) if d is not None else None, d is None or not s or root(d) == d) for d, s in sets]


def tokens(rows, tokenizer):
    """(doc_id, start, n, crc) in ascending order of id, null first."""
    import numpy as np

    out, start = [], 0
    encoded = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    for d, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes())):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
