"""Blocked scans against plain loops, with tiny blocks and one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from utterlake.operators import joins as J
from utterlake.operators import metrics as M
from utterlake.operators import ordered as O
from utterlake.operators import scans as R
from utterlake.operators import vad as V
from utterlake.params import VadConfig
from utterlake.streaming.processors import vad_step


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for key, n in (("hot", 90), ("b", 7), ("c", 1)):
        for seq in sorted(r.sample(range(400), n)):
            out.append((key, seq, r.choice([None, 1, 2, 3, 5]), r.random() < 0.3))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_running(spark, rows, width):
    d = spark.createDataFrame(rows, "k string, seq long, v long, r boolean")
    specs = {
        "s": O.Running("sum", F.col("v")),
        "m": O.Running("max", F.col("v")),
        "l": O.Running("last", F.col("v")),
        "p": O.Running("prev", F.col("v"), default=F.lit(-1)),
        "run": O.Running("run", F.lit(1), reset=F.col("r")),
    }
    got = {(x.k, x.seq): x for x in O.running(d, ["k"], "seq", specs, width).collect()}
    assert len(got) == len(rows)
    for key in {x[0] for x in rows}:
        total, top, last, prev, run = None, None, None, -1, 0
        for _, seq, v, reset in sorted(x for x in rows if x[0] == key):
            if v is not None:
                total, top, last = (total or 0) + v, max(top or 0, v), v
            run = 0 if reset else run + 1
            x = got[(key, seq)]
            assert (x.s, x.m, x.l, x.p, x.run) == (total, top, last, prev, run)
            prev = v


@pytest.mark.parametrize("width", [1, 5, 1000, None])
def test_recent(spark, rows, width):
    d = spark.createDataFrame(rows, "k string, seq long, v long, r boolean")
    got = {(x.k, x.seq): x.x for x in O.recent(d, ["k"], "seq", F.col("seq"), "x", 4, width).collect()}
    for key in {x[0] for x in rows}:
        seqs = sorted(x[1] for x in rows if x[0] == key)
        for i, seq in enumerate(seqs):
            assert got[(key, seq)] == seqs[max(0, i - 3) : i + 1]


@pytest.mark.parametrize("width", [10, 100000])
def test_asof_forward(spark, width):
    r = random.Random(5)
    marks = [(k, c, float(c) + 0.5) for k in ("hot", "b") for c in r.sample(range(1, 500), 60 if k == "hot" else 3)]
    probes = [(i, r.choice(["hot", "hot", "b", "none"]), r.randint(-5, 520)) for i in range(200)]
    m = spark.createDataFrame(marks, "k string, cursor long, at double")
    p = spark.createDataFrame(probes, "i long, k string, probe long")
    got = {x.i: x.at for x in J.asof_forward(p, m, ["k"], "probe", "cursor", "at", width).collect()}
    for i, k, probe in probes:
        later = [(c, at) for key, c, at in marks if key == k and c >= max(1, probe)]
        assert got[i] == (min(later)[1] if later else None)


def test_asof_literals(spark):
    m = spark.createDataFrame([(1, 4000, 1.0), (1, 8000, 1.25)], "k long, cursor long, at double")
    p = spark.createDataFrame([(1, 1), (1, 4000), (1, 4001), (1, 8001)], "k long, probe long")
    p = p.unionByName(p.limit(1).select("k", J.sample_cursor(F.lit(0.5), 16000).alias("probe")))
    got = {x.probe: x.at for x in J.asof_forward(p, m, ["k"], "probe", "cursor", "at").collect()}
    assert got == {1: 1.0, 4000: 1.0, 4001: 1.25, 8000: 1.25, 8001: None}


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_percentiles_through_brackets(spark, keys):
    import numpy as np

    r = random.Random(9)
    data = [("hot", r.choice([r.random(), 0.25, r.gauss(0, 9)])) for _ in range(3000)] + [("b", float(i)) for i in range(5)]
    d = spark.createDataFrame(data, "k string, v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    # A small accuracy makes the hot group go through brackets.
    got = M.exact_percentiles(d, keys, "v", wanted, accuracy=100).collect()
    groups = {"hot": [], "b": []} if keys else {None: []}
    for k, v in data:
        groups[k if keys else None].append(v)
    assert len(got) == len(groups)
    for row in got:
        values = groups[row.k if keys else None]
        for name, q in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


@pytest.mark.parametrize("fan", [2, 5, 4096])
def test_ewma(spark, fan, monkeypatch):
    monkeypatch.setattr(R, "FAN", fan)
    r = random.Random(2)
    data = [(k, i, r.choice([0.0, -1.0, r.random(), float("nan")])) for k, n in (("hot", 60), ("b", 3)) for i in r.sample(range(100), n)]
    d = spark.createDataFrame(data, "k string, seq long, v double")
    got = {(x.k, x.seq): x.ewma for x in R.ewma(d, ["k"], "seq", "v", 0.15).collect()}
    for key in ("hot", "b"):
        y = 0.0
        for _, seq, v in sorted((x for x in data if x[0] == key), key=lambda x: x[1]):
            if v > 0:
                y = v if y <= 0 else 0.15 * v + 0.85 * y
            assert got[(key, seq)] == pytest.approx(y, rel=1e-12)


@pytest.mark.parametrize("frames,ratio,expected", [([3, 3, 3], (16, 64), [0, 1, 1]), ([8] * 4, (24, 96), [2] * 4)])
def test_step_credit(spark, frames, ratio, expected):
    d = spark.createDataFrame([(1, i, f) for i, f in enumerate(frames)], "k long, seq long, f long")
    out = R.step_credit(d, ["k"], "seq", "f", *ratio).orderBy("seq").collect()
    assert [x.steps for x in out] == expected


def test_vad_windows_equal_fold(spark):
    c = VadConfig(-20.0, -30.0, 640, 640)
    r = random.Random(4)
    data = [(k, i, r.choice([-10.0, -25.0, -40.0])) for k, n in (("hot", 300), ("b", 20)) for i in range(n)]
    d = spark.createDataFrame(data, "k string, seq long, db double")
    got = {(x.k, x.seq): x.speech for x in V.speech_flags(d, ["k"], "seq", F.col("db"), F.lit(320), c).collect()}
    for key in ("hot", "b"):
        s = {"hot": 0.0, "quiet": 0.0, "speech": False}
        for _, seq, db in sorted((x for x in data if x[0] == key), key=lambda x: x[1]):
            assert got[(key, seq)] == vad_step(c, s, db, 320.0)


def test_range_rank(spark):
    r = random.Random(8)
    data = [(("hot" if i % 3 else "b"), r.random()) for i in range(200)]
    d = spark.createDataFrame(data, "k string, v double")
    out = J.range_rank(d, ["k"], [F.desc("v")], "rank").collect()
    for key in ("hot", "b"):
        mine = sorted((x for x in out if x.k == key), key=lambda x: -x.v)
        assert [x.rank for x in mine] == list(range(1, len(mine) + 1))


def words_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("codes", [2, M.CODES])
@pytest.mark.parametrize("bands_from", [2, 1000])
def test_edit_distance(spark, codes, bands_from, monkeypatch):
    """Two codes only make every pair clash, so both ways of naming words are tried, with bands and without."""
    monkeypatch.setattr(M, "CODES", codes)
    monkeypatch.setattr(M, "BANDS_FROM", bands_from)
    r = random.Random(6)
    data = [([r.choice("abcdé") for _ in range(r.randint(0, 9))], [r.choice("abcdé") for _ in range(r.randint(0, 9))]) for _ in range(80)]
    data += [(["a"] * 700, ["b"] * 690 + ["a"] * 5), (list("ab" * 60), list("ba" * 55)), (["a"], None), (None, None)]
    d = spark.createDataFrame(data, "a array<string>, b array<string>")
    for x in d.select("a", "b", M.edit_distance(F.col("a"), F.col("b")).alias("n")).collect():
        assert x.n == (None if x.a is None or x.b is None else words_distance(x.a, x.b))


def test_edit_distance_of_many_distinct_words(spark):
    """Enough distinct words for hashes to clash; short pairs beside it take the other way."""
    a = [f"w{i}" for i in range(20000)]
    b = a[:100] + ["x"] + a[101:9000] + a[9001:] + ["y"]
    d = spark.createDataFrame([(1, a, b), (2, ["a"], ["b", "a"]), (3, None, ["b"])], "k int, a array<string>, b array<string>")
    assert {r.k: r.n for r in M.edit_distances(d, "a", "b", "n").collect()} == {1: 3, 2: 1, 3: None}


def test_list_distance():
    r = random.Random(9)
    for _ in range(300):
        a = [r.randrange(4) for _ in range(r.randint(0, 40))]
        b = [x for x in a if r.random() < 0.8] if r.random() < 0.5 else [r.randrange(4) for _ in range(r.randint(0, 40))]
        assert M.list_distance(a, b, band=r.choice([1, 4, 16])) == words_distance(a, b)
    a = list(range(2_000_000))
    assert M.list_distance(a, a[:999_990] + [-1] + a[1_000_010:]) == 20


def test_containment_short_and_common_passages(spark):
    docs = [(i, "the cat sat on the mat".split()) for i in range(30)] + [(99, "a dog and the cat".split()), (100, [])]
    items = [(1, ["the"]), (2, "cat sat on the mat".split()), (3, "dog and".split()), (4, "mat the".split()), (5, [])]
    d = spark.createDataFrame(docs, "doc long, words array<string>")
    p = spark.createDataFrame(items, "item long, words array<string>")
    got = {(x.doc, x.item) for x in J.containment(d, p, "doc", "item").collect()}
    want = {
        (di, pi)
        for di, dw in docs
        for pi, pw in items
        if pw and any(dw[i : i + len(pw)] == pw for i in range(len(dw) - len(pw) + 1))
    }
    assert got == want


def test_latest_rows(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z")], "id string, n long, t string")
    assert {(x.id, x.t) for x in J.latest_rows(d, ["id"], F.col("n")).collect()} == {("a", "y"), ("b", "z")}


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_changes(spark, width):
    """Counts of changes, over sparse orders and one key with nine tenths of the rows."""
    r = random.Random(12)
    data = []
    for k, n in (("hot", 180), ("b", 15), ("c", 5)):
        at = 0
        for _ in range(n):
            at += r.choice([1, 1, 2, 1000])
            data.append((k, at, r.choice(["x", "y", None]), r.random() < 0.5))
    d = spark.createDataFrame(data, "k string, o long, v string, f boolean")
    specs = {
        "changed": O.Running("changes", F.col("v"), default=F.lit("x")),
        "on": O.Running("changes", F.col("f"), default=F.lit(False), where=F.col("f")),
        "was": O.Running("prev", F.col("v")),
        "total": O.Running("run", F.lit(1).cast("long"), reset=F.col("f")),
    }
    got = {(x.k, x.o): x for x in O.running(d, ["k"], "o", specs, width).collect()}
    assert len(got) == len(data)
    for key in ("hot", "b", "c"):
        before, changed, on, lit, was, run = "x", 0, 0, False, None, 0
        for _, o, v, f in sorted((x for x in data if x[0] == key), key=lambda x: x[1]):
            changed, on, run = changed + (v != before), on + (f and not lit), 0 if f else run + 1
            x = got[key, o]
            assert (x.changed, x.on, x.was, x.total) == (changed, on, was, run)
            before, lit, was = v, f, v
