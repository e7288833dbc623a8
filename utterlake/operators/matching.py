"""Longest-matching-block similarity of two lists, with the result of difflib.SequenceMatcher without junk."""

from __future__ import annotations

import difflib
from collections.abc import Hashable, Sequence

import numpy as np

PAIRS = 1 << 20


def _grams(x: np.ndarray, doublings: int) -> np.ndarray:
    """Equal numbers for equal runs of 2 ** doublings items, exactly: ranks of pairs of ranks."""
    for i in range(doublings):
        step = 1 << i
        if x.size <= step:
            return x[:0]
        x = np.unique(x[:-step] * (int(x.max()) + 1) + x[step:], return_inverse=True)[1].astype(np.int64)
    return x


def _runs(a: np.ndarray, b: np.ndarray, doublings: int) -> list[tuple[int, int, int]] | None:
    """Maximal equal runs (start in a, start in b, length) of at least 2 ** doublings items; None where there are too many."""
    size = 1 << doublings
    if a.size < size or b.size < size:
        return []
    grams = _grams(np.concatenate([a, [-1], b]) + 1, doublings)
    ga, gb = grams[: a.size - size + 1], grams[a.size + 1 :]
    order = np.argsort(gb, kind="stable")
    low, high = (np.searchsorted(gb[order], ga, side) for side in ("left", "right"))
    n = high - low
    total = int(n.sum())
    if total > PAIRS:
        return None
    i = np.repeat(np.arange(ga.size), n)
    j = order[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.ones(total, bool)
    first[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
    at = np.flatnonzero(first)
    lengths = np.diff(np.append(at, total)) + size - 1
    return list(zip(i[at].tolist(), j[at].tolist(), lengths.tolist(), strict=True))


def matched(a: Sequence[Hashable], b: Sequence[Hashable], doublings: int = 3) -> int:
    """Items in the matching blocks: the longest block, the earliest in a and then in b, and the same on both its sides.

    Runs of at least 2 ** doublings items are found once, by their grams; a rectangle looks among those that reach into it. Where none is
    that long in a rectangle, the plain search takes over for it. Where there are too many runs, it does the whole.
    """
    ids: dict[Hashable, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in s], np.int64) for s in (a, b))
    runs, size, total = _runs(x, y, doublings), 1 << doublings, 0
    if runs is None:
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    todo = [(0, len(a), 0, len(b), runs)]
    while todo:
        alo, ahi, blo, bhi, near = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        inside, best = [], (0, 0, 0)
        for run in near:
            i, j, n = run
            skip = max(0, alo - i, blo - j)
            left = min(n, ahi - i, bhi - j) - skip
            if left >= size:
                inside.append(run)
                best = min(best, (-left, i + skip, j + skip))
        if not inside:
            plain = difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False)
            total += sum(m.size for m in plain.get_matching_blocks())
            continue
        n, i, j = -best[0], best[1], best[2]
        total += n
        todo += [(alo, i, blo, j, inside), (i + n, ahi, j + n, bhi, inside)]
    return total


def ratio(a: Sequence[Hashable], b: Sequence[Hashable], doublings: int = 3) -> float:
    """2 M / T: twice the matched items over all items, 1 for two empty lists."""
    return 2.0 * matched(a, b, doublings) / (len(a) + len(b)) if len(a) + len(b) else 1.0
