"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _removed(units, window):
    """units: [(doc, sequence)]. The flags of removed places, by row."""
    first = {}
    for doc, seq in sorted(units, key=lambda u: u[0]):
        for p in range(len(seq) - window + 1):
            key = seq[p : p + window]
            if key not in first or (doc, p) < first[key]:
                first[key] = (doc, p)
    out = []
    for doc, seq in units:
        gone = bytearray(len(seq))
        for p in range(len(seq) - window + 1):
            if first[seq[p : p + window]] < (doc, p):
                gone[p : p + window] = b"\1" * window
        out.append(gone)
    return out


def op3(docs, window=100):
    units = [(d, (t or "").encode()) for d, t in docs]
    rows = []
    for (d, b), gone in zip(units, _removed(units, window), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        rows.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows)


def op7(docs, window=20):
    units = [(d, tuple(WORD.findall((t or "").encode()))) for d, t in docs]
    rows = []
    for (d, w), gone in zip(units, _removed(units, window), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        rows.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(rows)


def shingles(text, k):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(lower)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def op10(docs, k=3, percent=85):
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            both = len(s & r)
            if both and 100 * both >= percent * (len(s) + len(r) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)
