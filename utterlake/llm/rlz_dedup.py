"""Substring removal by relative Lempel-Ziv parsing over words.

The pieces that share an anchor are a reference block, indexed once by a suffix array. Each piece is then parsed greedily against
the block: a factor is the longest match of what follows at another place, found by search in the index at the factor's start only.
Windows inside a long enough factor are repeated; those across the end of a factor are looked up in the index one by one.
Very frequent anchors have several blocks, each parsed by itself, whose window digests are then compared (see `spans`).

Null texts have no words, texts shorter than the window keep all words, an empty table gives an empty table, repeated rows
are copies of each other and lose all windows. Columns of the input stay; those that the result adds replace columns of
the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from utterlake.llm import kernel as K
from utterlake.llm import spans as S
from utterlake.llm.suffix import first_keys, suffix_array


class Index:
    """A reference block: its pieces end to end, and their suffixes in order."""

    #: Symbols that are compared at once.
    STEP = 16

    def __init__(self, pieces: list[np.ndarray]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.ends = self.starts + sizes
        self.symbols = np.zeros(int(self.ends[-1]) + 1, pieces[0].dtype)
        for s, p in zip(self.starts.tolist(), pieces, strict=True):
            self.symbols[s : s + len(p)] = p
        #: symbols up to the end of the piece, the end included
        self.left = np.repeat(self.ends + 1, sizes + 1) - np.arange(len(self.symbols))
        self.order, self.rank = suffix_array(*first_keys(self.symbols, self.ends, self.left), self.left)
        self.padded = np.concatenate((self.symbols, np.zeros(self.STEP, self.symbols.dtype)))

    def neighbours(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes next to those at the given places, where the longest matches are; a place itself where there is none."""
        r, last = self.rank[at], len(self.order) - 1
        return np.where(r > 0, self.order[np.maximum(r - 1, 0)], at), np.where(r < last, self.order[np.minimum(r + 1, last)], at)

    def shared(self, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
        """Common symbols of the suffixes at a and b, up to the end of either piece (or to `most`); 0 for a place and itself."""
        limit = np.where(a == b, 0, np.minimum(self.left[a], self.left[b]) - 1)
        if most is not None:
            np.minimum(limit, most, out=limit)
        have = np.zeros(len(a), np.int64)
        live = np.flatnonzero(limit > 0)
        span = np.arange(self.STEP)
        while len(live):
            x, y = a[live] + have[live], b[live] + have[live]
            differ = self.padded[x[:, None] + span] != self.padded[y[:, None] + span]
            run = np.where(differ.any(1), differ.argmax(1), self.STEP)
            have[live] = np.minimum(have[live] + run, limit[live])
            live = live[(run == self.STEP) & (have[live] < limit[live])]
        return have

    def longest(self, at: np.ndarray, most: int | None = None) -> np.ndarray:
        """Length of the longest match of what follows each place at another place of the block."""
        before, after = self.neighbours(at)
        return np.maximum(self.shared(at, before, most), self.shared(at, after, most))


def parse(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of all pieces of a block, in step: (start, length). A symbol without a match is a factor of its own."""
    at, stop = index.starts, index.ends
    at, stop = at[at < stop], stop[at < stop]
    firsts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        size = np.minimum(np.maximum(index.longest(at), 1), stop - at)
        firsts.append(at)
        sizes.append(size)
        at = at + size
        at, stop = at[at < stop], stop[at < stop]
    return np.concatenate(firsts), np.concatenate(sizes)


def _repeated(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Repeated windows of the pieces of a block, by its factors."""
    if not pieces:
        return []
    index = Index(pieces)
    first, size = parse(index)
    out = np.zeros(len(index.symbols), bool)
    long_ = size >= length
    out[K.ranges(first[long_], size[long_] - length + 1)] = True
    # windows that begin in a factor and end past it, where the piece goes on for so long
    tail = np.minimum(size, length - 1)
    across = K.ranges(first + size - tail, tail)
    across = across[index.left[across] > length]
    out[across] = index.longest(across, length) >= length
    return [out[s : e - length + 1] for s, e in zip(index.starts.tolist(), index.ends.tolist(), strict=True)]


def dedup_words(df: DataFrame, text: str = "text", length: int = 35, gram: int = 10, hot: int = 4000, with_text: bool = True) -> DataFrame:
    """Add n_symbols (words), n_removed, n_spans, kept_sha256, spans (word offsets: start, end, ...) and kept_text.

    Each word inside a window of `length` words that also starts elsewhere is removed; kept_text is what is left, joined
    by single spaces.
    """
    new = ("n_symbols", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", "_k1", "_k2")
    clean = df.drop(*[c for c in df.columns if c.lower() in new])
    return S.cut_texts(clean, text, S.Method(True, length, gram, _repeated, hot), with_text)
