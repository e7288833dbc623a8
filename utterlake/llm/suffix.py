"""Suffix arrays of a block of strings by Larsson-Sadakane refinement, and their common prefixes by Kasai's rule."""

from __future__ import annotations

import numpy as np

from utterlake.llm import kernel as K


def first_keys(symbols: np.ndarray, ends: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys that order positions by their next symbols, and how many these are. 0 stands for an end and what is after it.

    Bytes: seven nine-bit fields. Other symbols: their rank.
    """
    n = len(symbols)
    if symbols.dtype == np.uint8:
        s = symbols.astype(np.uint64) + np.uint64(1)
        s[ends] = 0
        key, depth = s.copy(), 1
        for width in (1, 2, 3):  # 1 + 1, 2 + 2, 4 + 3 symbols
            more = np.zeros(n, np.uint64)
            more[: n - depth] = key[depth:]
            more[left <= depth] = 0
            if width == 3:
                more >>= np.uint64(9)  # three of four
            key = (key << np.uint64(9 * width)) | more
            depth += width
        return key, 7
    values = np.sort(symbols)
    values = values[K.group_starts(values)]
    key = np.searchsorted(values, symbols).astype(np.uint64) + np.uint64(1)
    key[ends] = 0
    return key, 1


def suffix_array(key: np.ndarray, depth: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, inverse). left: symbols up to the end of the string, the end included; equal rests keep their order.

    Larsson and Sadakane: positions are sorted by the ranks of what follows, the depth doubles each time, and only groups
    that are not yet split are sorted again.
    """
    n = len(key)
    sa = np.argsort(key)
    sorted_key = key[sa]
    first = K.group_starts(sorted_key)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)
    todo = np.flatnonzero(np.repeat(size > 1, size))
    most = int(left.max(initial=0))
    while len(todo) and depth < most:
        p = sa[todo]
        follows = np.where(depth < left[p], rank[np.minimum(p + depth, n - 1)] + 1, 0)
        key = rank[p].astype(np.uint64) << np.uint64(32) | follows.astype(np.uint64)
        order = np.argsort(key)
        p, key = p[order], key[order]
        first = K.group_starts(key)
        size = np.diff(np.append(first, len(key)))
        sa[todo] = p
        rank[p] = np.repeat(todo[first], size)
        # a group whose members have all ended stays as it is
        open_ = np.repeat((size > 1) & (left[p[first]] > 2 * depth), size)
        todo, depth = todo[open_], depth * 2
    # strings that are equal to their ends come in the order of their places
    tied = rank[sa]
    first = K.group_starts(tied)
    size = np.diff(np.append(first, n))
    todo = np.flatnonzero(np.repeat(size > 1, size))
    if len(todo):
        sa[todo] = np.sort(tied[todo].astype(np.uint64) << np.uint64(32) | sa[todo].astype(np.uint64)) & np.uint64((1 << 32) - 1)
    rank[sa] = np.arange(n)
    return sa, rank


def common_prefixes(sa, rank, key, depth: int, left, starts, lengths) -> np.ndarray:
    """Length of the common prefix of each position with the one before it in the suffix array (Kasai's rule).

    The strings are walked in step, one symbol at a time: a common prefix is at most one shorter than the one of the
    position before, so each comparison goes on where the last one ended.
    """
    out = np.zeros(len(sa) + depth, np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    h = np.zeros(len(starts), np.int64)
    padded = np.concatenate((key, np.zeros(1, np.uint64)))
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -t, "left"))  # lanes with more than t symbols
        p = starts[:live] + t
        r = rank[p]
        q = sa[np.maximum(r - 1, 0)]
        limit = np.where(r > 0, np.minimum(left[p], left[q]) - 1, 0)
        have = np.minimum(np.maximum(h[:live] - 1, 0), limit)
        go = np.flatnonzero(have < limit)
        while len(go):
            at = have[go]
            x = padded[p[go] + at] ^ padded[q[go] + at]
            same = x == 0
            if depth == 1:
                have[go[same]] += 1
            else:
                have[go[same]] += depth
                diff = x[~same]
                lead = np.zeros(len(diff), np.int64)
                for k in range(1, depth):
                    lead += diff < np.uint64(1 << (9 * (depth - k)))
                have[go[~same]] += lead
            go = go[same]
            np.minimum(have, limit, out=have)
            go = go[have[go] < limit[go]]
        h[:live] = have
        out[p] = have
    return out[: len(sa)]


def longest_matches(pieces: list[np.ndarray], tail: int = 0) -> list[np.ndarray]:
    """For each position of each piece the length of its longest match at another position of the block.

    The last `tail` positions of a piece are not measured; a match of more than `tail` symbols is never missed.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    if not len(pieces):
        return []
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    symbols = np.zeros(int(ends[-1]) + 1, pieces[0].dtype)
    for s, p in zip(starts.tolist(), pieces, strict=True):
        symbols[s : s + len(p)] = p
    left = np.repeat(ends + 1, lengths + 1) - np.arange(len(symbols))
    key, depth = first_keys(symbols, ends, left)
    sa, rank = suffix_array(key, depth, left)
    before = common_prefixes(sa, rank, key, depth, left, starts, np.maximum(lengths - tail, 0))
    after = np.zeros(len(sa), np.int64)
    after[sa[:-1]] = before[sa[1:]]
    best = np.maximum(before, after)
    return [best[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
