"""Pieces, fingerprints, quality, language and language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import odd_rows
from utterlake.llm import fingerprint, language, lm_scoring, pieces, quality
from utterlake.llm.gru import Model
from utterlake.llm.queries import PIECES, QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PIECES)


def test_pieces_round_trip(odd, empty):
    done = pieces.decode(pieces.encode(odd, PIECES, verified="lossless"), PIECES)
    assert done.columns[: len(odd.columns)] == odd.columns
    for r in done.collect():
        assert r.lossless
        assert r.decoded == (r.text or "")
        assert (len(r.ids) == 0) == (not r.text)
    assert pieces.decode(pieces.encode(empty, PIECES), PIECES).count() == 0


def test_pieces_are_the_same_in_other_partitions(odd):
    a, b = (pieces.encode(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(n), PIECES) for n in (1, 7))
    assert {r.doc_id: r.ids for r in a.collect()} == {r.doc_id: r.ids for r in b.collect()}


def test_pieces_follow_their_weights(vocabulary):
    n = 20000
    (ids, counts), = pieces.encode_texts(vocabulary, pa.array(["the"] * n), np.arange(n))
    at = np.concatenate(([0], np.cumsum(counts)))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    weight = {k: math.exp(vocabulary.weight[list(k)].sum()) for k in got}
    for k, c in got.items():
        assert abs(c / n - weight[k] / sum(weight.values())) < 0.02


def test_pieces_query(spark, sf):
    got = QUERIES["op2_pieces"](spark, sf).agg(F.count("*"), F.min("lossless"), F.min("n_pieces")).first()
    assert got[0] == 200 and got[1] and got[2] > 0


def test_fingerprint_neighbours(odd):
    rows = odd_rows()
    ordered = sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    texts = [r[1] or "" for r in ordered]
    want = Counter()
    for k, (r, t) in enumerate(zip(ordered, texts, strict=True)):
        n = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        want[r[0], len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    got = fingerprint.edit_likeness(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by_text = {}
    for r in fingerprint.fingerprints(odd).collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint


def test_fingerprint_tells_edits_from_others(spark, sf, docs):
    got = QUERIES["op4_fingerprints"](spark, sf)
    assert got.count() == docs.count()
    r = got.where("n_chars > 300").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > r[1] + 0.1
    pair = fingerprint.fingerprints(docs.limit(1)).withColumn("x", F.concat("text", F.lit(" and more")))
    pair = fingerprint.fingerprints(pair, "x", "other")
    assert pair.select(fingerprint.likeness_of(F.col("fingerprint"), F.col("other")).alias("y")).first().y > 0.7


def test_fingerprint_empty_and_single(spark, empty, docs):
    assert fingerprint.edit_likeness(empty).count() == 0
    one = fingerprint.edit_likeness(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_quality_counts(odd, empty, spark):
    labels = spark.createDataFrame([(4, None), (7, 1)], "doc_id long, quality int")
    got = quality.judge(odd, labels).collect()
    want = Counter((r[0], *brute.statistics(r[1])) for r in odd_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0


def test_quality_on_held_out_labels(spark, sf):
    path = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    got = quality.judge(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.95


def test_trees_are_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = (x[:, 0] + rng.normal(0, 0.4, 3000) < 0.5 + 0.3 * np.sin(9 * x[:, 1])).astype(float)
    trees = quality.fit(x, y, (-1, 0, 0))
    line = np.linspace(0, 1, 200)
    for a, b in rng.random((30, 2)):
        p = trees.score(np.stack([line, np.full(200, a), np.full(200, b)], 1))
        assert (np.diff(p) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75


def test_language(spark, sf, docs):
    rows = docs.where("lang is not null and n_chars > 100").select("doc_id", "lang", "text").collect()
    seen = docs.where("doc_id % 2 = 0")
    pages = spark.createDataFrame([(r.doc_id, None, f"<p>{r.text}</p>") for r in rows if r.doc_id % 2], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in language.identify(pages, seen).collect()}
    true = {r.doc_id: r.lang for r in rows if r.doc_id % 2}
    assert got.keys() == true.keys()
    assert sum(got[k] == true[k] for k in true) / len(true) > 0.95


def test_language_by_address_and_declaration(spark, docs):
    rows = [(i, f"http://h{i % 3}.example.com/en/{i}", '<html lang="en"><p>The and of this with that</p>') for i in range(30)]
    rows += [(100 + i, f"https://w.example.de/de/{i}", '<html lang="de"><p>der und nicht auch für sich</p>') for i in range(30)]
    rows += [(200, "http://h1.example.com/en/x", '<html lang="en">'), (201, "https://w.example.de/de/x", None), (202, None, None), (203, "no address", ""), (203, "no address", "")]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == 64 and got[200].lang == "en" and got[201].lang == "de" and got[202].lang is not None
    assert got[201].host == "w.example.de" and got[200].declared == "en"


def test_language_empty(spark, docs, empty):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(none, docs).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", "x")], none.schema)
    assert language.identify(one, empty).first().lang is None


def test_language_query(spark, sf):
    got = QUERIES["op9_language"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def base_scores(rows):
    tokens = [[*brute.words((t or "").translate(LOWER)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x, h in zip(rows, tokens, held, strict=True)]


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def test_lm_base_scores(odd, empty):
    want = by_id(base_scores([(r[0], r[1]) for r in odd_rows()]))
    got = by_id([tuple(r) for r in lm_scoring.score_texts(odd, held_out(), shard_bytes=30000).collect()])
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] <= 0
    assert lm_scoring.score_texts(empty, held_out()).count() == 0


def test_lm_beats_counts_on_held_out_rows(spark, sf):
    path = sf.replace("0.001", "0.01")
    got = QUERIES["op6_lm_scoring"](spark, path).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_vocabulary_grows_with_the_corpus(docs, monkeypatch):
    made = []

    def model(words, hidden, *args, **options):
        made.append((words, hidden))
        return Model(words, hidden, *args, **options)

    monkeypatch.setattr(lm_scoring, "Model", model)
    lm_scoring.score_texts(docs, held_out(), rounds=1)
    assert made[-1][0] >= 2048 and made[-1][1] >= 16
    n = lm_scoring.score_texts(docs, held_out(), words=4, rounds=1).first().train_tokens
    assert made[-1][0] == math.isqrt(n) > 4


def test_lm_probabilities_with_large_classes_sum_to_one():
    model = Model(5000, 8, counts=np.arange(5000, 0, -1), rest=50.0)
    assert model.size > 64
    h = np.random.default_rng(0).standard_normal((1, 8)).astype(np.float32)
    total = np.exp(model.log_probs(np.repeat(h, 5001, 0), np.arange(-1, 5000))[0]).sum()
    assert abs(total - 1) < 1e-4


def test_lm_probabilities_sum_to_one():
    model = Model(100, 8, counts=np.arange(100, 0, -1), rest=50.0)
    model.p["wc"] += 0.1
    h = np.random.default_rng(0).standard_normal((1, 8)).astype(np.float32)
    total = sum(math.exp(model.log_probs(h, np.array([w]))[0][0]) for w in range(-1, 100))
    assert abs(total - 1) < 1e-4


def test_lm_gradients():
    """Gradients of one step against differences, in the parameters of every layer."""
    rng = np.random.default_rng(4)
    model = Model(70, 4, counts=np.ones(70))
    for k in model.p:
        model.p[k] = (rng.standard_normal(model.p[k].shape) * 0.3).astype(np.float64)
    inputs, goal = rng.integers(0, 70, (5, 3)), rng.integers(-1, 70, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    live = np.ones((5, 3), bool)
    live[4, 2] = False

    def loss():
        h = model.recur(inputs, fresh, np.zeros((3, 4)))[0].astype(np.float64)
        some = np.flatnonzero(live.ravel())
        return -model.log_probs(h.reshape(-1, 4)[some], goal.ravel()[some])[0].sum() / len(some)

    before = {k: v.copy() for k, v in model.p.items()}
    adam = {}
    model.learn(inputs, fresh, goal, live, np.zeros((3, 4)), adam, 0.0)
    for k in before:
        model.p[k] = before[k]
        flat = np.argsort(-np.abs(adam["m" + k]).ravel())[:4]
        for at in flat:
            x = model.p[k].ravel()
            keep = x[at]
            x[at] = keep + 1e-2
            up = loss()
            x[at] = keep - 1e-2
            down = loss()
            x[at] = keep
            # the first moment holds a tenth of the gradient
            assert (up - down) / 2e-2 == pytest.approx(adam["m" + k].ravel()[at] * 10, rel=0.05, abs=2e-4)


def test_visible_text_and_declared_language():
    assert language.visible("a<b>c</b> <script>x<y></script>d<!-- e > -->f<style>g</STYLE >h") == "a c   d f h"
    assert language.visible("a < b <i>c") == "a  c" and language.visible("x <script>y") == "x  y" and language.visible("<!-- open <p>z") == " z"
    assert language.visible("no tags") == "no tags" and language.visible("") == "" and language.visible("a <b") == "a <b"
    assert language.declared_language('<html class="x" lang="de-AT">') == "de"
    assert language.declared_language('<html><meta http-equiv="Content-Language" content="fr">') == "fr"
    assert language.declared_language("<p lang=en>") is None


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    for part in ("<script ", "<", "<!-- ", "<html ", "<meta content-language ", "<style></scrip"):
        t = time.time()
        page = part * (400_000 // len(part))
        language.visible(page), language.declared_language(page)
        assert time.time() - t < 5, part


def test_many_language_labels(spark):
    """Labels beyond the limit are one language; no page is left out."""
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    docs = [(k, text("abcde"), "aa") for k in range(20)] + [(100 + k, text("vwxyz"), "zz") for k in range(20)] + [(200 + k, text("klmno"), f"l{k}") for k in range(30)]
    pages = [(1, "http://x.de/", f"<p>{text('abcde')}</p>"), (2, "http://y.de/", text("vwxyz")), (3, None, text("klmno")), (4, "http://x.de/a", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.page_id: r.text_lang for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), frame, languages=2).collect()}
    assert got.keys() == {1, 2, 3, 4} and (got[1], got[2], got[3]) == ("aa", "zz", "other")


def test_model_log_probs_equal_a_plain_softmax():
    """Also without the gradient, where probabilities are not worked out, and where logits need the clip."""
    import numpy as np

    from utterlake.llm.gru import Model

    rng = np.random.default_rng(2)
    h = np.tanh(rng.standard_normal((500, 16))).astype(np.float32)
    targets = rng.integers(-1, 300, 500)
    for scale in (1, 400):
        m = Model(300, counts=np.arange(300, 0, -1), rest=50.0)
        m.p["wo"] *= scale
        m.p["wc"] *= scale
        plain = lambda x: np.clip(x, -60, 60) - np.log(np.exp(np.clip(x, -60, 60)).sum(1, keepdims=True))
        first = plain(h.astype(float) @ m.p["wc"] + m.p["bc"])
        want = []
        for row, t in enumerate(targets):
            k = 0 if t < 0 else t // m.size + 1
            own = slice((k - 1) * m.size, k * m.size)
            inner = 0 if t < 0 else plain(h[row : row + 1].astype(float) @ m.p["wo"][own].T + m.p["bo"][own])[0, t % m.size]
            want.append(first[row, k] + inner)
        for grad in (None, {k: np.zeros_like(v) for k, v in m.p.items()}):
            got, dh = m.log_probs(h, targets, grad)
            assert np.allclose(got, want, rtol=1e-3, atol=1e-3) and (dh is None) == (grad is None)


def test_model_works_for_all_classes_at_once(monkeypatch):
    """Exponentials are taken for blocks of rows, whatever their classes; values and gradients are those of a softmax a class."""
    from utterlake.llm import gru

    rng = np.random.default_rng(3)
    m = Model(20000, 8, counts=np.arange(20000, 0, -1), rest=50.0)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    h = np.tanh(rng.standard_normal((900, 8)))
    # many rows in one class, some in none, classes without rows
    targets = np.concatenate((rng.integers(0, 300, 500), rng.integers(-1, 20000, 350), np.full(50, -1)))
    rng.shuffle(targets)
    want = {k: np.zeros_like(v) for k, v in m.p.items()}
    probs, back = np.zeros(900), np.zeros((900, 8))
    for r, t in enumerate(targets.tolist()):
        k = 0 if t < 0 else t // m.size + 1
        own = slice((k - 1) * m.size, k * m.size)
        levels = [(m.p["wc"].T, m.p["bc"], k, want["wc"].T, want["bc"])]
        if k:
            levels.append((m.p["wo"][own], m.p["bo"][own], t % m.size, want["wo"][own], want["bo"][own]))
        for w, b, place, gw, gb in levels:
            x = w @ h[r] + b
            d = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            probs[r] += math.log(d[place])
            d[place] -= 1
            gw += np.outer(d, h[r])
            gb += d
            back[r] += d @ w
    calls = []
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda *args, **options: calls.append(1) or exp(*args, **options))
    for block in (gru.BLOCK, 1 << 10):
        monkeypatch.setattr(gru, "BLOCK", block)
        calls.clear()
        grad = {k: np.zeros_like(v) for k, v in m.p.items()}
        got, dh = m.log_probs(h, targets, grad)
        assert len(calls) < 10 or block == 1 << 10
        np.testing.assert_allclose(got, probs, rtol=1e-6)
        np.testing.assert_allclose(dh, back, atol=1e-9)
        for k in ("wc", "bc", "wo", "bo"):
            np.testing.assert_allclose(grad[k], want[k], atol=1e-9)
    assert len(m.log_probs(h[:0], targets[:0])[0]) == 0
    np.testing.assert_allclose(m.log_probs(h, targets)[0], probs, rtol=1e-6)


def test_words_are_numbered_in_order():
    """Also where different hashes share their first bits; a table of the inputs gives the same states."""
    rng = np.random.default_rng(5)
    top = rng.integers(0, 1 << 62, 300).astype(np.uint64) << np.uint64(2)
    for h in (rng.choice(top, 5000), rng.choice(np.concatenate((top, top + np.uint64(1), top + np.uint64(3))), 5000), np.full(7, top[0]), top[:0], ~rng.choice(top, 64)):
        every, place = lm_scoring._numbered(h)
        want = np.unique(h, return_inverse=True)
        assert (every == want[0]).all() and (place == want[1]).all() and len(place) == len(h)
    model = Model(300, 8)
    inputs, fresh = rng.integers(0, 300, (30, 5)), rng.random((30, 5)) < 0.1
    state = np.tanh(rng.standard_normal((5, 8))).astype(np.float32)
    (a, last, *_), (b, also, *_) = model.recur(inputs, fresh, state), model.recur(inputs, fresh, state, model.table())
    np.testing.assert_allclose(a, b, atol=1e-6)
    np.testing.assert_allclose(last, also, atol=1e-6)
