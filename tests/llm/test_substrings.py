"""Both substring operators against a dictionary of all windows."""

from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import odd_rows
from utterlake.llm import kernel as K
from utterlake.llm.queries import QUERIES
from utterlake.llm.rlz_dedup import Index, _repeated, dedup_words, parse
from utterlake.llm.suffix import longest_matches
from utterlake.llm.suffix_dedup import dedup_bytes

CASES = [(dedup_bytes, brute.cut_bytes), (dedup_words, brute.cut_words)]


@pytest.mark.parametrize("operator, plain", CASES)
@pytest.mark.parametrize("hot", [1, 4000])
def test_odd_rows(odd, operator, plain, hot):
    rows = odd_rows()
    want = Counter((r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows]), strict=True))
    done = operator(odd, hot=hot)
    assert [c for c in odd.columns if c != "_k1"] == done.columns[: len(odd.columns) - 1]
    got = done.collect()
    assert Counter((r.doc_id, r.n_symbols, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed


@pytest.mark.parametrize("operator", [c[0] for c in CASES])
def test_empty_table(empty, operator):
    assert operator(empty).count() == 0


@pytest.mark.parametrize("name, plain, n", [("op3_suffix_dedup", brute.cut_bytes, "n_bytes"), ("op1_rlz_dedup", brute.cut_words, "n_words")])
def test_query(spark, sf, docs, name, plain, n):
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, plain([r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r[n], r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES[name](spark, sf).collect()}
    assert got == want


def test_kept_text(odd):
    for r in dedup_words(odd).collect():
        w = brute.words(r.text)
        gone = {i for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for i in range(a, b)}
        assert r.kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)
    for r in dedup_bytes(odd).collect():
        assert len(r.kept_text.encode()) >= r.n_symbols - r.n_removed


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_longest_matches(kind):
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 3, n).astype(kind) for n in (1, 2, 17, 40, 40, 60)]
    pieces += [pieces[3].copy(), np.zeros(30, kind)]
    strings = [[(k, tuple(p[i:].tolist())) for i in range(len(p))] for k, p in enumerate(pieces)]
    flat = [(k, i, s) for k, x in enumerate(strings) for i, (_, s) in enumerate(x)]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for k, m in enumerate(longest_matches(pieces)):
        for i, n in enumerate(m):
            assert n == max(common(strings[k][i][1], s) for kk, ii, s in flat if (kk, ii) != (k, i))


def test_factors_are_greedy():
    """Each factor is the longest match elsewhere of what follows, and factors cover the pieces."""
    rng = np.random.default_rng(2)
    pieces = [rng.integers(1, 4, n).astype(np.uint64) for n in (1, 5, 30, 47, 80)]
    pieces += [pieces[3][5:40].copy(), pieces[3].copy()]
    index = Index(pieces)
    best = np.concatenate(longest_matches(pieces))
    flat = np.concatenate([np.arange(s, e) for s, e in zip(index.starts, index.ends, strict=True)])
    longest = dict(zip(flat.tolist(), best.tolist(), strict=True))
    first, size = parse(index)
    assert sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(first, size, strict=True)]).tolist()) == flat.tolist()
    assert all(n == max(1, longest[a]) for a, n in zip(first.tolist(), size.tolist(), strict=True))


@pytest.mark.parametrize("length", [2, 5, 20])
def test_windows_of_factors(length):
    rng = np.random.default_rng(length)
    pieces = [rng.integers(1, 3, n).astype(np.uint64) for n in (20, 21, 33, 60, 90)]
    pieces += [np.concatenate([pieces[4][30:70], pieces[3][:25]])]
    seen = Counter(tuple(p[i : i + length].tolist()) for p in pieces for i in range(len(p) - length + 1))
    for p, got in zip(pieces, _repeated(pieces, length), strict=True):
        assert got.tolist() == [seen[tuple(p[i : i + length].tolist())] > 1 for i in range(len(p) - length + 1)]


def test_words_whose_power_sums_are_equal():
    """Two different words of 1,024 bytes that sums of powers modulo 2**64 can't tell apart, whatever the odd base."""
    bit = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = bytes(97 + x for x in bit), bytes(98 - x for x in bit)
    data = np.frombuffer(a + b" " + b, np.uint8)
    assert len(set(K.Words(data, np.array([0, len(data)])).hash.tolist())) == 2


def test_span_hash():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(0, 20, 3000)
    for values in (data, data.astype(np.uint64)):
        h = K.span_hash(values, start, end)
        parts = [values[a:b].tobytes() for a, b in zip(start, end, strict=True)]
        assert len(set(parts)) == len(set(h.tolist())) == len(set(zip(parts, h.tolist(), strict=True)))
