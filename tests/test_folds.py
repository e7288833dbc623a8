"""Folds by mergeable partials against plain loops, the streamed confirmation, and the command pool."""

import random
import time

from pyspark.sql import functions as F

from utterlake.operators import folds as L
from utterlake.operators.tokens import monotonic_confirm
from utterlake.streaming.transcribers import transcribe_command


def keyed_values(seed=4):
    """One key has most of the rows."""
    r = random.Random(seed)
    return {"hot": [r.randint(0, 9) for _ in range(1500)], "b": [r.randint(0, 9) for _ in range(5)], "one": [7]}


def test_number_folds(spark):
    data = keyed_values()
    rows = [(k, i, x) for k, v in data.items() for i, x in enumerate(v)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "k string, seq long, x long")
    for fan in (2, 64):
        ordered = L.ordered_fold(d, ["k"], "seq", lambda _: F.array("x"), lambda p, q: F.concat(p, q), "all", fan)
        assert {r.k: r["all"] for r in ordered.collect()} == data
    ewma = {r.k: r.y for r in L.ewma_fold(d, ["k"], "seq", F.col("x"), 0.25, "y").collect()}
    credit = {r.k: r.c for r in L.credit_fold(d, ["k"], "seq", F.col("x"), 24, 96, "c").collect()}
    for k, v in data.items():
        y = float(v[0])
        for x in v[1:]:
            y += 0.25 * (x - y)
        steps, pending = 0, 0.0
        for x in v:
            pending += x * 0.25
            whole = int(pending + 1e-9)
            steps, pending = steps + whole, pending - whole
        assert abs(ewma[k] - y) < 1e-9
        assert credit[k].steps == steps and abs(credit[k].pending - pending) < 1e-9


def test_list_folds(spark):
    words = [f"w{i}" for i in range(400)]
    chunks = [words[a : a + 9] for a in range(0, 392, 7)]
    rows = [("a", i, c) for i, c in enumerate(chunks)] + [("b", i, ["x", "y", *"abc"[: i + 1]]) for i in range(3)] + [("c", 0, []), ("c", 1, ["q"])]
    d = spark.createDataFrame(rows, "k string, seq long, w array<string>")
    merged = {r.k: r.m for r in L.merge_fold(d, ["k"], "seq", F.col("w"), "m").collect()}
    assert merged["a"] == words[: len(merged["a"])] and len(merged["a"]) == 7 * 55 + 9 and merged["c"] == ["q"]
    common = {r.k: r.p for r in L.confirm_fold(d, ["k"], "seq", F.col("w"), "p").collect()}
    assert common == {"a": [], "b": ["x", "y", "a"], "c": []}


def test_folds_of_an_empty_table(spark):
    d = spark.createDataFrame([], "k string, seq long, x long")
    assert L.ewma_fold(d, ["k"], "seq", F.col("x"), 0.5, "y").count() == 0


def test_monotonic_confirmation(spark):
    r = random.Random(5)
    rows, want = [], {}
    for k in ("hot", "b", None):
        held = None
        for i in range(300 if k == "hot" else 6):
            base = held or []
            w = r.choice([base + ["x"], base[:-1], ["z"], base, None, base + ["y", "z"]])
            rows.append((k, i, w))
            held = w if held is None else w if w is not None and w[: len(held)] == held else held
            want[k, i] = held
    random.Random(2).shuffle(rows)
    d = spark.createDataFrame(rows, "k string, seq long, w array<string>")
    got = {(x.k, x.seq): x.confirmed for x in monotonic_confirm(d, ["k"], "seq", "w").collect()}
    assert got == want


def test_commands(spark):
    script = 'case "$1" in slow) sleep 30;; bad) echo no json;; fail) echo why >&2; exit 4;; *) printf \'{"text": " %s "}\' "$1";; esac'
    items = ["plain", "slow", "bad", "fail", "a; echo b", "$(echo c)", None]
    d = spark.createDataFrame(list(enumerate(items)), "id long, item string")
    t = time.time()
    out = {r.id: r for r in transcribe_command(d, "id", "item", ["/bin/sh", "-c", script, "x", "{item}"], 1.0, "text").collect()}
    assert time.time() - t < 25
    assert [out[k].status for k in range(7)] == ["ok", "timeout", "bad output", "failed", "ok", "ok", "ok"]
    assert [out[k].text for k in range(7)] == ["plain", None, None, None, "a; echo b", "$(echo c)", ""]
    assert out[3].code == 4 and out[3].error == "why" and out[1].infer_sec >= 1.0
    gone = transcribe_command(d, "id", "item", ["/no/such/program"], 1.0).collect()
    assert {r.status for r in gone} == {"failed"}


def test_folds_of_lists_equal_folds_of_rows(spark):
    """Items in lists of unlike length, empty ones too, give what single rows give; several folds run at once."""
    data = keyed_values(9)
    r, rows = random.Random(3), []
    for k, v in data.items():
        at = 0
        while at < len(v):
            n = r.choice([0, 1, 5, 64])
            rows.append((k, len(rows), v[at : at + n], v[at : at + n] if r.random() < 0.8 else []))
            at += n
    d = spark.createDataFrame(rows, "k string, seq long, xs array<long>, ys array<long>")
    folds = {"y": (L.ewma(0.25), F.col("xs"), lambda x: x), "c": (L.credit(24, 96), F.col("ys"), lambda x: x)}
    got = {x.k: x for x in L.over_lists(d, ["k"], "seq", folds).collect()}
    for k, v in data.items():
        y = float(v[0])
        for x in v[1:]:
            y += 0.25 * (x - y)
        kept = sum(sum(x[3]) for x in rows if x[0] == k)
        assert abs(got[k].y - y) < 1e-9
        assert (got[k].c is None) == (not any(x[3] for x in rows if x[0] == k)) and (got[k].c is None or got[k].c.steps == int(kept * 0.25 + 1e-9))
