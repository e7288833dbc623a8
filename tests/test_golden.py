"""Known input and output pairs of the array, text and planning functions."""

import pytest
from pyspark.sql import functions as F

from utterlake.functions import arrays as A
from utterlake.functions import signal as G
from utterlake.functions import text as X
from utterlake.operators import backlog as B
from utterlake.operators import planning as P
from utterlake.operators import stabilize as S
from utterlake.operators import tokens as T


def words(text):
    return F.array(*[F.lit(w) for w in text.split()]) if text.split() else F.array().cast("array<string>")


def ids(*values):
    return F.array(*[F.lit(v).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


@pytest.mark.parametrize(
    "required,partials,expected",
    [
        (2, ["hello wor", "hello world", "hello world from"], [("", "hello wor"), ("hello", "world"), ("hello world", "from")]),
        (
            2,
            ["alpha beta", "alpha beta one", "alpha zeta one two", "alpha zeta one two three"],
            [None, None, ("alpha", "zeta one two"), ("alpha zeta one two", "three")],
        ),
    ],
)
def test_local_agreement(spark, required, partials, expected):
    rows = [(1, 1, i, t.split()) for i, t in enumerate(partials)]
    d = spark.createDataFrame(rows, "stream long, segment long, seq long, words array<string>")
    out = S.local_agreement(d, ["stream", "segment"], "seq", "words", required).orderBy("seq").collect()
    for row, want in zip(out, expected, strict=True):
        if want is not None:
            assert (" ".join(row.confirmed), " ".join(row.hypothesis)) == want


def test_flush_confirms_latest(spark):
    rows = [(1, 1, 1, ["testing", "local"], False), (1, 1, 2, ["testing", "local"], False), (1, 1, 3, [], True)]
    d = spark.createDataFrame(rows, "stream long, segment long, seq long, words array<string>, f boolean")
    out = S.flush_rows(d, ["stream", "segment"], "seq", "words", F.col("f")).collect()
    assert [r.confirmed for r in out] == [["testing", "local"]]


def test_revision_ignores_moved_words(spark):
    rows = [(1, 1, "alpha beta"), (1, 2, "alpha beta"), (1, 3, "alpha beta"), (1, 4, "alpha gamma")]
    d = spark.createDataFrame(rows, "stream long, seq long, m string")
    out = S.revisions(d, ["stream"], "seq", F.col("m")).orderBy("seq").collect()
    assert [r.revision for r in out] == [1, 1, 1, 2]


def test_append_with_overlap(one):
    assert one(A.append_with_overlap(words("so i have created"), words("so i have created here"))) == "so i have created here".split()
    assert one(A.append_with_overlap(words("a b c"), words("c d"))) == list("abcd")
    assert one(A.append_with_overlap(words("x a b c d y"), words("a b c d"))) == "x a b c d y".split()
    assert one(A.append_with_overlap(words("x a b c d y"), words("a b c d e f"))) == "x a b c d y e f".split()
    assert one(A.append_with_overlap(words(""), words("a"))) == ["a"]


def test_collapse_self_overlap():
    assert T.collapse_words("Okay. I have the kind of So I have the kind of that's.".split()) == "Okay. I have the kind of that's.".split()
    assert T.collapse_words("Okay. I have So I have".split()) == "Okay. I have".split()


def test_self_overlap_pass_matches_python(spark):
    import random

    r = random.Random(7)
    rows = [([r.choice("abc") for _ in range(r.randint(0, 9))],) for _ in range(60)]
    rows += [("Okay. I have the kind of So I have the kind of that's.".split(),)]
    d = spark.createDataFrame(rows, "w array<string>").select("w", A.self_overlap_pass(F.col("w")).alias("x"))
    for row in d.collect():
        step = T._collapse_once(row.w, [T._edge_norm(w) for w in row.w])
        assert row.x == (step[0] if step else row.w), row.w


def test_window_merge(one):
    m = one(A.window_merge(ids(99, 10, 11, 77, 10, 11, 12, 13), ids(10, 11, 12, 13, 14, 15)))
    assert (m.merged, m.strategy, m.alignment_start, m.match_length) == ([99, 10, 11, 77, 10, 11, 12, 13, 14, 15], "aligned_replace", 4, 4)
    m = one(A.window_merge(ids(1, 2, 3), ids(4, 5, 6, 7, 8)))
    assert (m.merged, m.strategy) == ([4, 5, 6, 7, 8], "replace_all")
    assert one(A.window_merge(ids(), ids(4))).strategy == "seed_next"
    assert one(A.window_merge(ids(4), ids())).strategy == "keep_base"


def test_ctc(spark):
    seq = [0, 1, 1, 0, 2, 3, 3, 4, 0]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(seq)], "utt long, step long, id long")
    out = T.ctc_collapse(d, ["utt"], "step", "id", 0)
    assert [r.id for r in out.orderBy("step").collect()] == [1, 2, 3, 4]
    vocab = spark.createDataFrame([(1, "▁hello"), (2, "▁world"), (3, "!")], "id long, piece string")
    d = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "utt long, step long, id long")
    assert T.ctc_detokenize(d, vocab, ["utt"], "step", "id").first().text == "hello world!"


def test_catch_up_and_onset(one):
    n = lambda q: one(B.catch_up_count(F.lit(q), F.lit(2), F.lit(6), F.lit(2)))
    assert (n(7), n(2), n(0)) == (6, 2, 0)
    assert one(B.onset_protect(F.lit(0.3), F.lit(1), F.lit(0), 2, 0.8))
    assert not one(B.onset_protect(F.lit(0.9), F.lit(1), F.lit(0), 2, 0.8))
    assert not one(B.onset_protect(F.lit(0.3), F.lit(2), F.lit(0), 2, 0.8))
    assert not one(B.onset_protect(F.lit(0.3), F.lit(1), F.lit(1), 2, 0.8))


def test_duration_select(one):
    d = F.array(*[F.lit(i) for i in range(5)])
    pick = lambda s, blank=True: one(A.duration_select(F.array(*[F.lit(x) for x in s]), F.lit(blank), d, 0.25))
    assert pick([-14.1, -1.17, -1.00, -1.60, -2.11]) == 1
    assert pick([-10.0, -1.5, -0.9, -2.5, -3.0]) == 2
    assert pick([-14.1, -1.17, -1.00, -1.60, -2.11], blank=False) == 2
    assert pick([-0.9, -1.5, -1.0, -2.5, -3.0]) == 2


def test_window_plans(one):
    before, after = (P.window_keys(F.lit(t), 1200, 160, 0) for t in (2200, 2600))
    assert one(A.prefix_reuse(before, after)) == 2
    s = one(P.window_project(F.lit(300), F.lit(920), F.lit(1080), F.lit(1200), F.lit(520), 1040))
    assert (s.step_start, s.step_start + s.step_count) == (40, 300)
    s = one(P.window_project(F.lit(300), F.lit(2080), F.lit(2080), F.lit(920), F.lit(520), 1040))
    assert (s.step_start, s.step_count) == (0, 300)
    flags = lambda *f: F.array(*[F.lit(x) for x in f])
    assert one(A.leading_true(flags(True, True, False, True), F.lit(4))) == 2
    assert one(A.leading_true(flags(True, True, True), F.lit(2))) == 2


def test_anchor_and_tail(one):
    assert one(A.anchor_promote(ids(*range(1, 9)), ids(1, 2, 3, 4, 5, 6, 9, 10), 6))
    assert not one(A.anchor_promote(ids(*range(1, 7)), ids(1, 2, 9, 10, 11, 12), 6))
    tail = lambda n: one(A.tail_frame_count(F.lit(24), F.lit(n), 12, 4, 8))
    assert (tail(1), tail(5)) == (12, 20)


def test_text_functions(one):
    assert one(X.normalize_basic(F.lit("  It's 5 o'Clock -- Ünd\tso "))) == "it's 5 o'clock nd so"
    assert one(X.normalize_compare(F.lit("A--b  c"))) == "a b c"
    assert one(X.edge_punct_norm(F.lit("\"(Don't!)…"))) == "don't"
    assert one(X.merged_transcript(F.lit(" a "), F.lit(""))) == "a"
    assert one(X.stride_id(F.lit(0.5))) == "stride_0p5"
    assert one(X.stride_id(F.lit(1.0))) == "stride_1"
    assert one(F.size(X.tokenize(F.lit("")))) == 0
    assert one(X.preview(F.lit("a\nb"), 2)) == "a "
    assert one(X.safe_float(F.lit("x"))) is None


def test_audio_functions(one):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(G.energy_dbfs(F.array().cast("array<double>"))) == -120.0
    assert one(G.energy_dbfs(v(1, -1))) == 0.0
    assert one(G.to_mono(F.array(v(1, 2, 3), v(3, 4, 5)))) == [2.0, 3.0, 4.0]
    assert one(G.to_mono(F.array(v(1, 3), v(3, 5), v(5, 7)))) == [2.0, 4.0, 6.0]
    assert one(G.loudest_channel(F.array(v(1, 1), v(1, 1), v(0, 2)))) == 2
    assert one(G.resample_linear(v(0, 2, 4, 6), 2.0, 4.0)) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0]
    assert one(A.slice_or_pad(v(1), 3)) == [1.0, 0.0, 0.0]
    assert one(A.log_softmax(F.array().cast("array<double>"))) == []
    assert one(A.percentile_of(v(4, 1, 3, 2), 0.5)) == 2.5


def test_align_payload_empty_is_null(one):
    none = F.array(F.lit(" "))
    k = A.align_payload(none, F.array(F.lit(0.1)), F.array().cast("array<array<double>>"))
    assert one(k) is None
