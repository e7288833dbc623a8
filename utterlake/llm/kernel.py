"""Array helpers that the operators share: text buffers, word tables, rolling hashes and sliding minima.

All work on one bounded chunk of whole texts at a time. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_rng = np.random.default_rng(0x5EED)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_CODE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1

#: The white space of the contracts, U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept by a process. Functions travel to the executors with the
    globals they use; these tables stay behind and are made anew."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def grow(self, n: int) -> None:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, CHUNK + 4096), base, np.uint64)
            a[0] = 1
            setattr(self, name, np.multiply.accumulate(a))


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.up) < n:
        _POWERS.grow(n)
    return _POWERS.up[:n], _POWERS.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums; part_hash reads the hash of any part off them."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def part_hash(sums: np.ndarray, start, end) -> np.ndarray:
    """Hash of the parts [start, end) of the sequence behind prefix_hash."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the parts [start, end) of bytes or 64-bit values by their contents: eight bytes or one value at a time are mixed
    into what has come before. Unlike sums of powers modulo 2**64 this has no family of different parts that meet."""
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = 8 if values.dtype == np.uint8 else 1
    if step == 8:
        padded = np.concatenate((values, np.zeros(8, np.uint8)))
        blocks = np.ndarray((len(values) + 1,), np.uint64, padded, strides=(1,))
        masks = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        value = (blocks if step == 8 else values)[start[live] + k]
        if step == 8:
            short = np.flatnonzero(size[live] - k < 8)
            value[short] &= masks[size[live[short]] - k]
        h[live] = mix(h[live] * np.uint64(0xD6E8FEB86659FD93) ^ value)
        k += step
        live = live[size[live] > k]
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours; len(a) - w + 1 values."""
    have, m = 1, a
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.type in (pa.string(), pa.binary()):
        texts = texts.cast(pa.large_binary() if texts.type == pa.binary() else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if texts.type == pa.large_binary() else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most size bytes, or of one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j
        i = j


def text_chunks(texts, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for each chunk of a string column."""
    data, offs = buffers(texts)
    for i, j in chunks(offs, size):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a chunk: byte ranges, texts they belong to, hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, hashed: bool = True):
        n = len(data)
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offs[:-1][offs[:-1] < n]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offs[1:][offs[1:] > 0] - 1
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: offsets of the texts in the word table
        self.offs = np.searchsorted(self.start, offs)
        self.count = np.diff(self.offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        if hashed:
            self.hash = span_hash(data, self.start, self.end)


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def sums_by(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each slice [offs[i], offs[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of the ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
