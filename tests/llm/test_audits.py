"""Toxicity, filter interaction audit and phrase collocations against plain versions."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import odd_rows
from utterlake.llm.collocations import collocations
from utterlake.llm.filter_audit import audit, bit_counts
from utterlake.llm.queries import QUERIES
from utterlake.llm.toxicity import Lexicon, fold, toxicity

LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit ----


def plain_audit(rows, labels):
    """Rows of the audit from each order applied document by document."""
    good, bad = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w = brute.words(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in bad))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                earlier = sum(1 for d in own if f in d[1]) - len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), earlier, sum(1 for d in own if d[1] == {f}), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(total[key[1][key[2] - 1]])
    return out


def test_bit_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 33, 97, 5000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]
        assert bit_counts(words).tolist() == want


def test_audit_of_odd_rows(spark, odd, empty):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (10, 1, None), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(labels, LABELS)
    want = plain_audit([(r[0], r[1], r[2]) for r in odd_rows()], [x for x in labels if x[0] is not None])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit(odd, frame).collect()}
    assert got == want
    assert audit(empty, frame).count() == 0


def test_audit_without_labels(spark, odd):
    rows = audit(odd, spark.createDataFrame([], LABELS)).collect()
    assert rows and all(r.good_lost == 0 and r.toxic_lost == 0 for r in rows)


def test_audit_of_one_text_many_times(spark):
    """A third of all rows is one text: the first id survives E, whatever part the copies are in."""
    rows = [(k, "same text" if k % 3 == 0 else f"text {k}", ["a", "b"][k % 2]) for k in range(6000)]
    got = {(r.part, r.step): r for r in audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD'").collect()}
    assert got["a", 1].removed == 999 and got["b", 1].removed == 1000 and got["a", 1].kept == 2001
    assert got["a", 5].kept == got["b", 5].kept == 0


# ---- phrases ----


def plain_collocations(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(seed=5):
    rng = random.Random(seed)
    words = ["Of", "the", "é", "漢字", "x\x00y", "a", "very", "long" * 300]
    texts = [None, "", " .,;", "alone", "the " * 40, "New York City. " * 12, "the a\nthe a\vthe a\t a"]
    texts += [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(f"rare{rng.randint(0, 400)}" for _ in range(3000))]
    return [(k, t, rng.choice(["en", "de", None])) for k, t in enumerate(texts)]


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_collocations(spark, shards):
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in collocations(frame, shards=shards, cells=1 << 10).collect())
    assert got == plain_collocations([(t, x) for _, t, x in rows])


def test_collocations_with_full_bitmaps(spark):
    """Bitmaps of a single cell let everything through; the counts stay exact."""
    rows = phrase_rows(6)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in collocations(frame, shards=2, cells=1, least=12, top=20).collect())
    assert got == plain_collocations([(t, x) for _, t, x in rows], 12, 20)


def test_collocations_of_odd_rows(odd, empty):
    got = sorted(tuple(r) for r in collocations(odd, least=3, shards=2, cells=1 << 10).collect())
    assert got == plain_collocations([(r[1], r[2]) for r in odd_rows()], 3)
    assert collocations(empty, shards=2, cells=8).count() == 0


def test_scores_beyond_64_bits(spark):
    """The quotient of the score is exact where its products pass 64 bits."""
    a, l, r = 3_000_000_017, 3_000_000_019, 9_000_000_001
    frame = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = (wide("a") * wide("a")).cast("decimal(38,0)") * F.lit(1000000).cast("decimal(7,0)")
    got = frame.select(top.alias("t"), (wide("l") * wide("r")).cast("decimal(38,0)").alias("u")).select(F.expr("t div u").cast("long")).first()[0]
    assert got == 1000000 * a * a // (l * r)


# ---- toxicity ----


def test_fold():
    assert fold("An 1D10T, аn іdіоt, ｉｄｉｏｔ and an ídiot!") == " an idiot an idiot idiot and an idiot "
    assert fold("tr@sh w0rthle$$ cl0wn$ 1984 3.5") == " trash worthie ciown 1984 3 5 "
    assert fold(None) == fold("") == " "
    assert fold("s​c­um") == " scum "


def test_matches_and_exceptions():
    own = Lexicon({" idiot ": 2.0, " mor": 1.0, " moron ": 3.0}, [" idiot savant "])
    found = lambda text: [t for t, _, _ in own.hits(fold(text))]
    assert found("idiot, idiots and 1diot") == [" idiot ", " idiot "]
    assert found("an idiot savant, the idiot") == [" idiot "]
    assert found("moronic moron amoral") == [" mor", " moron "]
    assert Lexicon({}).hits(" idiot ") == []


def planted(n=900, seed=4):
    """Texts of random words, a quarter toxic: insults in plain, disguised and inflected forms; `grumb` is spared before `tree`."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkmnoprst") for _ in range(rng.randint(3, 7)))
    common = [word() for _ in range(300)]
    disguise = lambda w: w.translate(str.maketrans({"o": "0", "e": "3"})) if rng.random() < 0.3 else w.replace("o", "о") if rng.random() < 0.3 else w
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), disguise(rng.choice(["grumbo", "snoterel", "vilpo" + rng.choice(["s", "ten", "lich", "ade"])])))
        elif k % 4 == 1:
            w.insert(rng.randrange(len(w)), "grumbo tree")
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_planted_texts(spark):
    rows, labels = planted()
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    copies = [(10_000 + k, rows[4][1]) for k in range(400)]  # one toxic text in a third of the rows
    frame = spark.createDataFrame(rows + copies, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(i, 1, 1) for i, _ in copies], LABELS)
    got = {r.doc_id: r for r in toxicity(frame, marks, held).collect()}
    assert len(got) == len(rows) + len(copies) and all(0 <= r.score <= 1 for r in got.values())
    out = [r for r in got.values() if r.held_out and r.doc_id < 10_000]
    assert len(out) > 100
    right = sum(r.predicted == labels[r.doc_id][2] for r in out) / len(out)
    assert right >= 0.97
    spared = [r for r in out if r.doc_id % 4 == 1]
    assert spared and sum(r.predicted for r in spared) <= 1
    # labels of held-out rows are not read
    turned = spark.createDataFrame([(i, q, 1 - t if got[i].held_out else t) for i, q, t in labels] + [(i, 1, 1) for i, _ in copies], LABELS)
    again = {r.doc_id: r for r in toxicity(frame.repartition(3), turned, held).collect()}
    assert all(abs(again[i].score - r.score) < 1e-9 for i, r in got.items())


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(0, 22)] + [(3, 1, None), (None, 1, 1)], LABELS)
    for given in (labels, labels.where("toxic = 1"), labels.limit(0)):
        rows = toxicity(odd, given, F.col("doc_id") % 5 == 0).collect()
        assert Counter((r.doc_id, r.slot) for r in rows) == Counter((r[0], r[5]) for r in odd_rows())
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        by = defaultdict(set)
        for r in rows:
            by[r.doc_id].add(r.score)
        assert all(len(s) == 1 for i, s in by.items() if i is not None)
    assert toxicity(empty, labels, F.lit(False)).count() == 0
    clash = spark.createDataFrame([(1, "x", 5, 6)], "doc_id long, text string, score int, held_out int")
    assert toxicity(clash, labels, F.lit(False)).dtypes[1:] == [("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def test_toxicity_query(spark, sf):
    sf = sf.replace("0.001", "0.01")  # the smaller tables have ten toxic rows
    rows = QUERIES["op11_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    hit, miss = [s for s, t in own if t], [s for s, t in own if not t]
    assert sum(a > b for a in hit for b in miss) + sum(a == b for a in hit for b in miss) / 2 >= 0.9 * len(hit) * len(miss)
