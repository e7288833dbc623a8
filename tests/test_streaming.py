"""Stateful processors: known event sequences, order restoration, and equality with the batch forms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from utterlake.functions import arrays as A
from utterlake.operators import backlog as B
from utterlake.operators import vad as V
from utterlake.params import StabilizerConfig, VadConfig
from utterlake.plans import fixtures as fx
from utterlake.plans.stabilizing import VAD
from utterlake.streaming import jobs as S
from utterlake.streaming import processors as P


def feed(processor, rows):
    """Run a processor's row logic and rebuild the stream's visible text per event."""
    state = {"last": None, **processor.fresh()}
    events, text = [], []
    for i, (action, partial, speech) in enumerate(rows):
        row = {"stream": 1, "seq": i, "action": action, "text": partial, "speech": speech, "dbfs": 0.0, "frame_ms": 320.0}
        for e in processor.rows(state, row):
            text += e["committed"].split()
            shown = [] if e["is_flush"] or action != "hop" else P.appended(text, e["confirmed"].split())
            events.append((" ".join(text + shown), e["hypothesis"], e["is_flush"]))
    return events, state


def hops(partials, speech):
    return [("hop", p, s) for p, s in zip(partials, speech, strict=True)]


def test_two_hops_and_flush():
    events, _ = feed(P.StabilizerProcessor(), hops(["hello", "hello world", ""], [True, True, False]))
    assert events == [("", "hello", False), ("hello", "world", False), ("hello world", "", True)]


def test_two_segments():
    rows = hops(["hello", "hello world", "", "how", "how are", ""], [True, True, False] * 2)
    events, state = feed(P.StabilizerProcessor(), rows)
    assert len(events) == 6
    assert events[-1] == ("hello world how are", "", True)
    assert state["count"] == 4


def test_discard_keeps_draft():
    rows = [("hop", "so i have", True), ("discard_keep", "", False), ("hop", "so i have created", True)]
    events, _ = feed(P.StabilizerProcessor(), rows)
    assert events[-1] == ("so i have", "created", False)


def test_discard_then_mismatch():
    rows = [("hop", "so i have", True), ("discard_keep", "", False), ("hop", "yeah mm", True), ("hop", "yeah mm", True)]
    events, _ = feed(P.StabilizerProcessor(), rows)
    assert events[-2:] == [("", "yeah mm", False), ("yeah mm", "", False)]


def test_plain_discard_drops_draft():
    rows = [("hop", "so i have", True), ("discard", "", False), ("hop", "so i have created", True)]
    events, _ = feed(P.StabilizerProcessor(), rows)
    assert events[1] == ("", "", False)
    assert events[-1] == ("", "so i have created", False)


def test_run_limit_and_silence_flush_together():
    c = StabilizerConfig(run_limit=2, decode_only_when_speech=False)
    events, _ = feed(P.StabilizerProcessor(c), hops(["a", "a b"], [True, False]))
    # The forced flush and the end-of-speech flush both come out.
    assert [e[2] for e in events] == [False, False, True, True]
    assert events[-1][0] == "a b"


def test_stagnation_flush():
    c = StabilizerConfig(stagnation_limit=2)
    events, _ = feed(P.StabilizerProcessor(c), hops(["a b"] * 5, [True] * 5))
    assert [e[2] for e in events].count(True) == 1


def test_finish_commits():
    events, _ = feed(P.StabilizerProcessor(), [("hop", "one two", True), ("finish", "", False)])
    assert events[-1] == ("one two", "", True)


def test_revision_counts_text_changes():
    _, state = feed(P.StabilizerProcessor(), hops(["alpha beta", "alpha beta", ""], [True, True, False]))
    assert state["revision"] == 1


def test_overlap_rule_matches_column_form(spark):
    r = random.Random(11)
    rows = [([r.choice("abc") for _ in range(r.randint(0, 14))], [r.choice("abc") for _ in range(r.randint(0, 8))]) for _ in range(200)]
    d = spark.createDataFrame(rows, "b array<string>, s array<string>")
    for x in d.select("b", "s", A.append_with_overlap(F.col("b"), F.col("s")).alias("m")).collect():
        assert x.m == x.b + P.appended(x.b, x.s), (x.b, x.s)


def test_credit_with_larger_minimum():
    p = P.CreditProcessor(16, 64, 3)
    state = {"last": None, **p.fresh()}
    steps = [p.rows(state, {"stream": 1, "seq": i, "frames": 3})[0]["steps"] for i in range(4)]
    assert steps == [0, 3, 0, 3]


def test_vad_stream_equals_batch_across_batches(spark, sf):
    d = fx.en(spark, sf).withColumn("frame_ms", F.col("frame_ms").cast("double"))
    parts = [d.where("seq < 400"), d.where("seq >= 400")]
    got = S.run_to_table(S.keyed(S.staged(spark, parts, "t-vad"), "stream", P.VadProcessor(VAD)), "t-vad-out")
    want = V.speech_flags(d, ["stream"], "seq", F.col("dbfs"), F.col("frame_ms"), VAD).select("stream", "seq", "speech")
    assert got.exceptAll(want).count() == 0 and got.count() == d.count()


def test_late_rows_are_set_apart(spark):
    schema = "stream long, seq long, frames long"
    parts = [spark.createDataFrame(x, schema) for x in ([(1, 5, 8), (1, 2, 8), (2, 9, 8)], [(1, 3, 8), (1, 6, 8), (2, 9, 8), (2, 1, 8)])]
    feed = S.keyed(S.staged(spark, parts, "t-late"), "stream", P.CreditProcessor(24, 96, 1))
    out, late = S.run_with_late(feed, "t-late-out")
    assert sorted((r.stream, r.seq, r.steps) for r in out.collect()) == [(1, 2, 2), (1, 5, 2), (1, 6, 2), (2, 9, 2)]
    assert sorted(tuple(r) for r in late.collect()) == [(1, 3), (2, 1), (2, 9)]


def test_late_rows_of_the_stabiliser(spark):
    schema = "stream long, seq long, action string, text string, speech boolean, dbfs double, frame_ms double"
    row = lambda k, text: (1, k, "hop", text, True, 0.0, 320.0)
    parts = [spark.createDataFrame(x, schema) for x in ([row(3, "a\u00a0b")], [row(2, "late"), row(4, "a b c")])]
    out, late = S.run_with_late(S.keyed(S.staged(spark, parts, "t-late"), "stream", P.StabilizerProcessor()), "t-late-out")
    assert [(r.seq, r.confirmed) for r in out.orderBy("seq").collect()] == [(3, ""), (4, "a b")]
    assert [tuple(r) for r in late.collect()] == [(1, 2)]


def test_vad_needs_ordered_levels(spark, sf):
    bad = VadConfig(start_dbfs=-40.0, end_dbfs=-30.0)
    with pytest.raises(ValueError):
        V.speech_flags(fx.en(spark, sf), ["stream"], "seq", F.col("dbfs"), F.col("frame_ms"), bad)


@pytest.mark.parametrize("latest", [True, False])
@pytest.mark.parametrize("hard", [None, 6])
def test_shedding(spark, latest, hard):
    rows = [("hot", i) for i in range(20)] + [("b", i) for i in range(3)] + [("c", 1)]
    d = spark.createDataFrame(rows, "k string, seq long")
    out = B.shed(d, ["k"], "seq", soft=3, target=2, context=4, latest_first=latest, hard=hard).collect()
    for key in ("hot", "b", "c"):
        queue = sorted(s for k, s in rows if k == key)
        left = queue if hard is None else queue[-hard:]
        aim = max(1, 2, 4 if latest else 1)
        if len(left) > 3 and len(left) > aim:
            left = left[-aim:] if latest else left[:aim]
        assert sorted(x.seq for x in out if x.k == key and x.kept) == left
        assert {x.resync for x in out if x.k == key} == {len(left) < len(queue)}


def shuffled_frames(spark, n, seed):
    r = random.Random(seed)
    rows = [(7, k, r.choice([-10.0, -25.0, -40.0]), 320.0) for k in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "stream long, seq long, dbfs double, frame_ms double")


def test_a_hot_key_is_worked_on_block_by_block(spark, monkeypatch):
    """Rows of one key in many Arrow batches are parked by block; the result is that of the batch form."""
    monkeypatch.setattr(P.VadProcessor, "block", 64)
    d = shuffled_frames(spark, 1000, 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = S.run_to_table(S.keyed(S.staged(spark, [d], "t-hot"), "stream", P.VadProcessor(VAD)), "t-hot-out")
        want = V.speech_flags(d, ["stream"], "seq", F.col("dbfs"), F.col("frame_ms"), VAD).select("stream", "seq", "speech")
        assert got.count() == 1000 and got.exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blocks_hold_a_part_of_a_hot_key_only():
    """What is handed on at once is a block, not the micro-batch."""
    import pandas as pd

    class Parked(dict):
        getValue = dict.__getitem__

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

    p = P.VadProcessor(VAD)
    p.parked, p.block = Parked(), 100
    order = list(range(5000))
    random.Random(1).shuffle(order)
    frames = (pd.DataFrame({"stream": 1, "seq": order[a : a + 200], "dbfs": 0.0, "frame_ms": 320.0}) for a in range(0, 5000, 200))
    parts = list(p.blocks(frames))
    assert max(map(len, parts)) == 100 and [r["seq"] for part in parts for r in part] == list(range(5000))
    assert not p.parked


def test_state_of_a_hot_stream_stays_flat(spark):
    """A stream in many small batches keeps the state of a stream in one, and its results."""
    schema = "stream long, seq long, action string, text string, speech boolean, dbfs double, frame_ms double"
    rows = [(1, k, "hop", " ".join(f"w{j}" for j in range(k % 40, k % 40 + 5)), k % 9 != 8, 0.0, 320.0) for k in range(120)]
    one = spark.createDataFrame(rows, schema)
    parts = [one.where(f"seq div 20 = {k}") for k in range(6)]
    feed = S.keyed(S.staged(spark, parts, "t-flat"), "stream", P.StabilizerProcessor(StabilizerConfig(run_limit=8)))
    sizes = []
    out = S.run(feed, "t-flat-out", lambda w, path: w.format("parquet").outputMode("append").option("path", path), sizes.append)
    got = spark.read.schema(feed.stream.schema).parquet(out)
    whole = S.run_to_table(S.keyed(S.staged(spark, [one], "t-one"), "stream", P.StabilizerProcessor(StabilizerConfig(run_limit=8))), "t-one-out")
    assert got.drop("late").exceptAll(whole).count() == 0 and got.count() == whole.count()
    held = [o.numRowsTotal for progress in sizes for p in progress for o in p.stateOperators]
    # one value and the committed words, of which the last 2,048 are kept
    assert max(held) <= 2 + P.SEARCH


def test_idle_streams_are_finished(spark):
    schema = "stream long, seq long, action string, text string, speech boolean, dbfs double, frame_ms double"
    row = lambda s, k, text: (s, k, "hop", text, True, 0.0, 320.0)
    parts = [spark.createDataFrame(x, schema) for x in ([row(1, 1, "a b"), row(2, 1, "c d")], [row(3, 1, "e")])]
    # timers need a query that runs on
    feed = S.keyed(S.staged(spark, parts, "t-idle"), "stream", P.StabilizerProcessor(idle_ms=500, ttl_ms=3_600_000))
    for part in parts:
        part.write.mode("append").parquet(feed.path)
    q = feed.stream.writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()
    done, end = {}, time.time() + 60
    while time.time() < end and len(done) < 3:
        time.sleep(1)
        done = {r.stream: r.confirmed for r in spark.table("idle").where("is_flush").collect()}
    q.stop()
    assert done == {1: "a b", 2: "c d", 3: "e"}


def test_late_rows_are_counted(spark):
    """Kept rows, copies and late ones add up to what was read; the late ones are a table."""
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    first = [(k, at(k)) for k in range(200)]
    second = [(1000, at(10)), (1001, at(139)), (1002, at(140)), (1003, at(300)), (5, at(5)), (199, at(199))]
    parts = [spark.createDataFrame(x, "id long, ts timestamp") for x in (first, second)]
    t = S.deduplicated_with_late(S.staged(spark, parts, "t-count", key=None), "ts", ["id"], 3600000, "t-count")
    assert sorted(r.id for r in t.late.collect()) == [5, 1000, 1001] and t.n_late == 3
    kept = sorted(r.id for r in t.kept.collect())
    assert kept == [*range(200), 1002, 1003]
    assert t.n_read == len(first) + len(second) == len(kept) + t.n_late + 1  # id 199 came twice


def test_latency_over_several_epochs_equals_the_batch_result(spark):
    r = random.Random(2)
    schema = "stream long, seq long, kind int, cursor long, time double, place long"
    rows, want = [], {}
    for s, n in ((1, 60), (2, 7)):
        marks = [(k * 100, k * 0.3 + r.random() / 9) for k in range(1, n + 1)]
        rows += [(s, 0, 0, c, t, 2 * k) for k, (c, t) in enumerate(marks)]
        for k in range(n):
            cursor, ready = max(1, (k + 1) * 100 - r.randint(0, 250) + r.choice([0, 0, 500])), k * 0.3 + 0.5
            rows.append((s, k, 1, cursor, ready, 2 * k + 1))
            hit = next((t for c, t in marks if c >= cursor), None)
            if hit is not None:
                want[s, k] = max(0.0, (ready - hit) * 1000)
    d = spark.createDataFrame(rows, schema)
    parts = [d.where(f"place >= {a} and place < {b}") for a, b in ((0, 10), (10, 50), (50, 999))]
    done = S.latency_stream(S.staged(spark, parts, "t-lat"), "t-lat-out", 1000)
    got = {(x.stream, x.seq): x.ms for x in done.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert done.count() == len(want) and S.latency_stats(done, ["stream"]).count() == 2


def test_committed_words_take_few_state_items(spark):
    """The committed words of a stream are read and written in items of many words, across micro-batches as well."""
    schema = "stream long, seq long, action string, text string, speech boolean, dbfs double, frame_ms double"
    rows = [(1, k, "hop", " ".join(f"w{j}" for j in range(8 * k, 8 * k + 8)), k % 2 == 0, 0.0, 320.0) for k in range(120)]
    one = spark.createDataFrame(rows, schema)
    feed = S.keyed(S.staged(spark, [one.where("seq < 70"), one.where("seq >= 70")], "t-items"), "stream", P.StabilizerProcessor())
    seen = []
    out = S.run(feed, "t-items-out", lambda w, path: w.format("parquet").outputMode("append").option("path", path), seen.append)
    last = spark.read.schema(feed.stream.schema).parquet(out).orderBy("seq", "part").collect()[-1]
    assert last.committed_words == 60 * 8
    held = [o.numRowsTotal for progress in seen for p in progress for o in p.stateOperators]
    assert 2 <= max(held) <= 1 + -(-last.committed_words // P.ITEM)


def test_word_list_helpers_equal_plain_loops():
    r = random.Random(8)
    for _ in range(2000):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        b = r.choice([b, a[: r.randint(0, len(a))] + b, a[r.randint(0, len(a)) :] + b])
        same = [x == y for x, y in zip(a, b)]
        assert P.common_prefix([a, b]) == a[: (same + [False]).index(False)]
        for limit in (1, 3, 64):
            fits = [k for k in range(1, min(limit, len(a), len(b)) + 1) if a[-k:] == b[:k]]
            assert P.end_overlap(a, b, limit) == max(fits, default=0)
