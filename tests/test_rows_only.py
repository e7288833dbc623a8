"""Queries without an oracle statement, against their batch forms or plain Python."""

import difflib
import random

import __spark_entry__ as entry
from utterlake.operators import tokens as T


def rows(spark, sf, name):
    return entry.queries()[name](spark, sf)


def collapse_by_search(words):
    """Every split, skip and overlap length in turn."""
    n, best = len(words), None
    for split in range(1, n):
        for skip in range(min(2, max(0, n - split - 1)) + 1):
            start, tail = split + skip, n - split - skip
            over = next((k for k in range(min(split, tail), 0, -1) if words[split - k : split] == words[start : start + k]), 0)
            if over >= 3 or (over == tail and tail >= 2):
                kept = words[:split] + words[start + over :]
                if best is None or len(kept) < len(best):
                    best = kept
    return best if n >= 4 else None


def test_collapse_against_search():
    r = random.Random(1)
    for _ in range(3000):
        words = [r.choice("abcd"[: r.randint(2, 4)]) for _ in range(r.randint(0, 14))]
        step = T._collapse_once(words, words)
        assert (step and step[0]) == collapse_by_search(words)


def test_sequence_ratio(spark, sf):
    from utterlake.plans.scoring import pairs

    got = {r.id: r.words for r in rows(spark, sf, "ag21_sequence_match_ratio").collect()}
    for p in pairs(spark, sf).where("sys = 'a'").collect():
        m = difflib.SequenceMatcher(None, p.ref.split(), p.hyp.split(), autojunk=False)
        assert got[p.id] == round(m.ratio(), 6)


def test_streamed_shedding_equals_batch(spark, sf):
    a, b = rows(spark, sf, "st7_load_shedding"), rows(spark, sf, "st7_load_shedding_stream").select("stream", "day", "seq", "kept", "resync")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_batch_trace_covers_all_rows(spark, sf):
    from utterlake.plans import fixtures as fx

    out = rows(spark, sf, "st12_batch_trace").collect()
    assert [r.trace_batch_index for r in sorted(out)] == sorted(r.trace_batch_index for r in out)
    assert sum(r.batch_chunk_count for r in out) == fx.part(spark, sf).count()


def test_streamed_latency_counts(spark, sf):
    from utterlake.operators.latency import with_ingress
    from utterlake.plans import fixtures as fx

    d = with_ingress(fx.live(spark, sf), fx.mark(spark, sf), ["stream"]).where("ingress_at is not null")
    want = {r.stream: r["count"] for r in d.groupBy("stream").count().collect()}
    assert {r.stream: r.n for r in rows(spark, sf, "st11_streaming_latency").collect()} == want


def test_detector_in_place_of_the_speech_column(spark, sf):
    from utterlake.plans import streams as Q
    from utterlake.streaming import jobs as S
    from utterlake.streaming import processors as P

    feed = Q.halves(spark, Q.control_rows(spark, sf), "t-speech")
    want = S.run_to_table(S.keyed(feed, "stream", P.StabilizerProcessor(Q.NO_LIMITS, collapse=False)), "t-speech-out")
    got = rows(spark, sf, "uf4_swappable_detector")
    want = want.select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
