from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tests.llm.conftest import odd_rows
from utterlake.llm import kernel as K
from utterlake.llm.minhash import components, keep_first, near_duplicates, shingles, signatures, similarity
from utterlake.llm.queries import QUERIES


def test_odd_rows(odd):
    rows = [r for r in odd_rows() if r[0] is not None]
    want = Counter(zip([r[0] for r in rows], brute.near_classes([(r[0], r[1]) for r in rows]), strict=True))
    got = near_duplicates(odd.where("doc_id is not null"))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == want
    first = keep_first(odd)
    assert first.columns == odd.columns
    kept = Counter(r.doc_id for r in first.collect())
    assert max(kept.values()) == 1
    assert set(kept) == {c for _, c in want}


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0
    assert keep_first(empty).count() == 0


def test_query(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip([r[0] for r in rows], brute.near_classes(rows), strict=True))
    assert {r.doc_id: r.class_id for r in QUERIES["op10_minhash_dedup"](spark, sf).collect()} == want


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_similarity_and_estimate():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = ({int(k): int(rng.integers(1, 6)) for k in rng.choice(60, 40, replace=False)} for _ in range(2))
        both = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
        want = probability_jaccard(a, b)
        assert abs(similarity(*both) - max(plain, want)) < 1e-9
        doc = np.repeat([0, 1], [len(a), len(b)])
        sig = signatures(doc, K.mix(np.concatenate([x[0] for x in both]) + np.uint64(99)), np.concatenate([x[1] for x in both]), 2, 4096)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_shingles_stay_in_their_text():
    data, offs = K.buffers(pa.array(["a b c d e f", "a b", None, "a b c d e a b c d e"], pa.large_string()))
    doc, _, weight, at = shingles(K.Words(data, offs), 5)
    assert Counter(doc.tolist()) == {0: 2, 3: 5}
    assert weight.sum() == 2 + 6
    assert at.tolist() == [0, 2, 2, 2, 7]


def test_near_copies_that_repeat_a_passage(spark):
    """Plain similarity 0.96 and 0.93, low probability similarity: only the signature without weights sees them."""
    rows = []
    for k in range(10):
        words = [f"w{k}x{i}" for i in range(104)]
        texts = (words, words + words[-24:] * 20, words[:24] * 20 + words)
        rows += [(3 * k + i, " ".join(x)) for i, x in enumerate(texts)]
    want = dict(zip([r[0] for r in rows], brute.near_classes(rows), strict=True))
    assert want == {i: i - i % 3 for i in range(30)}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_components_of_a_long_chain(spark):
    ids = list(range(150))
    links = spark.createDataFrame([(i, i + 1) for i in ids[:-1]], "_a long, _b long")
    assert {r._id: r._class for r in components(links).collect()} == {i: 0 for i in ids}
