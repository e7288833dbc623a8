"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def cut_repeats(items, length, join):
    """(symbols, removed, spans, sha256) of each sequence after removal of all repeated windows."""
    seen = Counter(hash(tuple(s[i : i + length]) if not isinstance(s, bytes) else s[i : i + length]) for s in items for i in range(len(s) - length + 1))
    out = []
    for s in items:
        gone = bytearray(len(s) + 1)
        for i in range(len(s) - length + 1):
            w = s[i : i + length]
            if seen[hash(w if isinstance(w, bytes) else tuple(w))] > 1:
                gone[i : i + length] = b"\1" * length
        gone[len(s)] = 0
        spans = sum(1 for i in range(len(s)) if gone[i] and not (i and gone[i - 1]))
        kept = join([s[i] for i in range(len(s)) if not gone[i]])
        out.append((len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cut_bytes(texts, length=200):
    return cut_repeats([(t or "").encode() for t in texts], length, bytes)


def cut_words(texts, length=35):
    return cut_repeats([words(t) for t in texts], length, lambda w: " ".join(w).encode())


def near_classes(rows, size=5, least=0.8):
    """Smallest id of the class of each (id, text): equal texts, and plain Jaccard similarity of shingles of `least` or more."""
    sets = [(i, t or "", frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))) for i, t in rows for w in [words(t)]]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, (_, ta, sa) in enumerate(sets):
        for b in range(a):
            _, tb, sb = sets[b]
            if ta == tb or (sa and sb and len(sa & sb) >= least * len(sa | sb)):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(sets):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return [low[find(k)] for k in range(len(sets))]


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets of sources given in order, by sharing the excess again until none is above its limit."""
    total, fixed = share * sum(sizes), {}
    while True:
        rest = total - sum(fixed.values())
        free = [k for k in range(len(sizes)) if k not in fixed]
        weight = sum(weights[k % len(weights)] for k in free)
        above = [k for k in free if rest * weights[k % len(weights)] / weight >= most * sizes[k]] if weight else []
        if not above:
            return [fixed.get(k, rest * weights[k % len(weights)] / weight if weight else 0) for k in range(len(sizes))]
        fixed |= {k: most * sizes[k] for k in above}
