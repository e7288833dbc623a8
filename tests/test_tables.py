"""Readers and writers on small files."""

import os

import pytest
from pyspark.sql import functions as F

from utterlake.functions import text as X
from utterlake.operators import sweep as W
from utterlake.session import cut_lineage, scratch, shared_dir
from utterlake.sources import io
from utterlake.streaming.processors import split_words


def put(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_utterances_last_wins(spark):
    path = scratch(spark, "t-utt")
    put(path, "a.jsonl", '{"ordinal":1,"id":7,"text":"x"}\n\n{"ordinal":2,"id":"7","text":"y","audio_sec":2}\n')
    rows = io.scan_utterances(spark, path).collect()
    assert [(r.id, r.text, r.audio_sec, r.infer_sec) for r in rows] == [("7", "y", 2.0, None)]


def test_trace_skips_junk(spark):
    path = scratch(spark, "t-trace")
    put(path, "a.jsonl", '{"kind":"step","trace":1,"step_index":0}\n{bad\n\n[1]\n"x"\n{"kind":"chunk","trace":1}\n')
    assert [(r.trace, r.step_index) for r in io.scan_trace(spark, path).collect()] == [(1, 0)]


def test_speaker_lines_stop_at_limit(spark):
    lines = ["[0.0 -> 1.0] Speaker 0: one", "noise", "[5.0 -> 6.0] Speaker 1:  ", "[9.0 -> 9.5] Speaker 1: far", "[2.0 -> 3.0] Speaker 0: later"]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file long, ordinal long, line string")
    out = io.parse_speaker_lines(d, ["file"], "ordinal", "line", 8.0).collect()
    assert [r.text for r in out] == ["one"]


def test_speaker_line_grammar(spark):
    root = scratch(spark, "t-speakers")
    tight, wide = "[0->1.5]Speaker 0:a\u00a0b", "\t[2.0  ->\u00a03]\u3000Speaker  12:  c \u3000"
    bad = ["[x -> 2] Speaker 0: no", "[3 -> 4 Speaker 0: no", "[3 -> 4]Speaker0: no", "(3 -> 4) Speaker 0: no"]
    put(f"{root}/file=4", "t.txt", "\r\n".join([tight, *bad, wide]))
    put(f"{root}/file=5", "t.txt", "  [1.0 -> 2.0] Speaker 3: d")
    rows = io.scan_speaker_lines(spark, root).orderBy("file", "ordinal").collect()
    assert [(r.file, r.ordinal, r.start_sec, r.end_sec, r.speaker, r.text) for r in rows] == [
        (4, 0, 0.0, 1.5, 0, "a\u00a0b"), (4, 5, 2.0, 3.0, 12, "c"), (5, 0, 1.0, 2.0, 3, "d"),
    ]


def test_malformed_lines_fail_or_are_set_apart(spark):
    path, rejects = scratch(spark, "t-bad"), scratch(spark, "t-rejects")
    put(path, "a.jsonl", '{"ordinal":1,"id":7,"text":"x"}\n{bad\n\u00a0\n{"ordinal":"one"}\n')
    with pytest.raises(Exception, match="malformed line"):
        io.scan_utterances(spark, path).collect()
    assert [r.id for r in io.scan_utterances(spark, path, rejects).collect()] == ["7"]
    assert sorted(r.value for r in spark.read.text(rejects).collect()) == ['{"ordinal":"one"}', "{bad"]
    rejects = scratch(spark, "t-rejects")
    assert io.scan_manifest_samples(spark, path, rejects=rejects).count() == 1
    assert spark.read.text(rejects).count() == 2


def test_manifest_lines_are_stripped(spark):
    path = scratch(spark, "t-manifest")
    head = "dataset\tprofile\trun_name\tstatus"
    put(path, "m.tsv", f"\n  {head}\n d\tp\tr1\tok \n{head}\n\u00a0\n")
    rows = io.scan_run_manifest(spark, path).collect()
    assert [tuple(r) for r in rows] == [("d", "p", "r1", "ok"), ("dataset", "profile", "run_name", "status")]


def test_quoted_numbers_of_a_summary(spark):
    m = spark.createDataFrame([("d", "p", "r", "ok")], "dataset string, profile string, run_name string, status string")
    text = '{"global_metrics": {"wer": {"global_result": "0.1"}}, "rtf": "slow", "num_samples": "12", "speed_x": 2}'
    r = W.manifest_report(m, spark.createDataFrame([("r", text)], "run_name string, summary string")).first()
    assert (r.status, r.wer, r.rtf, r.num_samples, r.speed_x) == ("ok", 0.1, None, 12, 2.0)


def test_a_run_without_text_fails_the_gate(spark):
    rows = [(s, r, 2.0, 1.0, 1.0, 0, t) for s, r, t in ((0.25, 0, "x"), (0.5, 0, "x"), (0.5, 1, None), (0.75, 0, "x"))]
    runs = spark.createDataFrame(rows, "stride double, repetition int, infer_rtfx double, primary_ms double, p95_ms double, corrections long, text string")
    got = {r.stride: r["pass"] for r in W.sweep_aggregate(runs, 0.25).collect()}
    assert got == {0.25: True, 0.5: False, 0.75: True}


def test_settings_without_candidates(spark):
    rows = [(0.25, 0, None, None, None, None, "x")]
    runs = spark.createDataFrame(rows, "stride double, repetition int, infer_rtfx double, primary_ms double, p95_ms double, corrections long, text string")
    lines = W.settings_text(W.recommend(W.sweep_aggregate(runs, 0.25)), 5.0).collect()
    assert [r.value for r in lines] == ["# latency_equivalence_ms=5.0\n# no passing candidate found"]


def test_words_split_at_any_white_space(spark):
    text = "a\u00a0b\u3000c d\u2009e\x85f\tg\u200bh"
    words = spark.range(1).select(X.tokenize(F.lit(text)).alias("w"), X.strip_all(F.lit("\u00a0 x\u3000\n")).alias("s")).first()
    assert words.w == ["a", "b", "c", "d", "e", "f", "g\u200bh"] == split_words(text)
    assert words.s == "x"


def test_manifest_and_summaries(spark):
    path, root = scratch(spark, "t-man"), scratch(spark, "t-sum")
    put(path, "m.tsv", "dataset\tprofile\trun_name\tstatus\nd\tp\tr1\tok\nd\tp\tr2\tok\nd\tp\tr3\tok\nd\tp\tr4\tfailed\nbroken line\n")
    put(f"{root}/run_name=r1", "summary.json", '{\n "global_metrics": {"wer": {"global_result": 0.25}},\n "rtf": 0.5, "num_samples": 3}\n')
    put(f"{root}/run_name=r2", "summary.json", "{oops")
    put(f"{root}/run_name=r4", "summary.json", '{"rtf": 1.0}')
    report = W.manifest_report(io.scan_run_manifest(spark, path), io.scan_run_summaries(spark, root))
    got = {r.run_name: (r.status, r.wer) for r in report.collect()}
    assert got == {"r1": ("ok", 0.25), "r2": ("invalid_summary", None), "r3": ("missing_summary", None), "r4": ("failed", None)}


def test_vocab_and_text(spark):
    path = scratch(spark, "t-vocab")
    put(path, "v.txt", "<blank>\n▁a\nb\n")
    assert [(r.id, r.piece) for r in io.scan_vocab(spark, path).orderBy("id").collect()] == [(0, "<blank>"), (1, "▁a"), (2, "b")]
    root = scratch(spark, "t-text")
    put(f"{root}/file=1", "t.txt", "\n two\nlines \n")
    assert [r.text for r in io.scan_text(spark, root).collect()] == ["two\nlines"]


def test_csv_report_joins_lists(spark):
    path = scratch(spark, "t-csv")
    d = spark.createDataFrame([(1, ["a", "b"])], "n long, reasons array<string>")
    io.write_csv_report(d, path, ["reasons", "n"])
    assert spark.read.option("header", True).csv(path).collect()[0].asDict() == {"reasons": "a; b", "n": "1"}


def test_samples_limit_and_id(spark):
    path = scratch(spark, "t-samples")
    put(path, "s.jsonl", '{"ordinal":0,"sampling_rate":2,"array":[1,2,3]}\n{"ordinal":1,"id":"z","sampling_rate":0,"array":[1]}\n')
    rows = io.scan_manifest_samples(spark, path).orderBy("ordinal").collect()
    assert [(r.id, r.audio_sec) for r in rows] == [("0", 1.5), ("z", 1.0)]
    assert io.scan_manifest_samples(spark, path, 1).count() == 1


def test_shared_dir_is_taken_from_the_session(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            assert name == "spark.checkpoint.dir"
            return self.value or default

    class Session:
        sparkContext = spark.sparkContext

    session = Session()
    session.conf = Conf("hdfs://shared/ckpt/")
    assert shared_dir(session) == "hdfs://shared/ckpt"
    session.conf = Conf(None)
    assert shared_dir(session) == shared_dir(session)
    assert cut_lineage(spark.range(3), "t-cut").count() == 3


def test_recommendation_without_candidates(spark):
    runs = spark.createDataFrame([(0.25, 0, None, None, None, None, "x")], "stride double, repetition int, infer_rtfx double, primary_ms double, p95_ms double, corrections long, text string")
    agg = W.sweep_aggregate(runs, 0.25)
    row = agg.first()
    assert row["pass"] is False and row.fail_reasons == ["infer_rtfx < 1.2"] and row.corrections_max == 0
    assert W.recommend(agg).count() == 0
    passing = agg.withColumn("pass", F.lit(True))
    out = W.recommend(passing).collect()
    assert [(r.recommended, r.cutoff) for r in out] == [(True, None)]


def test_trace_fields(spark, tmp_path):
    """Every key of a step comes back, with the candidates; a step without them has nulls."""
    import json

    step = {"source": "a", "kind": "step", "chunk_index": 1, "step_index": 2, "encoder_steps": 90, "t": 7, "token_id": 5, "duration_idx": 1, "duration_value": 2, "skip": 2, "prev_token": 4, "token_piece": "x", "emitted": True, "commit_state": 1}
    more = step | {"token_topk": [{"token_id": 5, "token_piece": "x", "logp": -0.5}], "duration_topk": [{"duration_idx": 1, "duration_value": 2, "logp": -0.1}]}
    path = str(tmp_path / "trace")
    spark.createDataFrame([(json.dumps(x),) for x in (step, more)], "value string").write.text(path)
    rows = sorted(io.scan_trace(spark, path).collect(), key=lambda r: r.token_topk is not None)
    for r in rows:
        assert all(r[k] == v for k, v in step.items())
    assert rows[0].duration_topk is None and rows[1].token_topk[0].logp == -0.5 and rows[1].duration_topk[0].duration_value == 2


def test_packed_texts(spark, tmp_path):
    """Few files for many texts; a single text is read from its folder alone."""
    import glob

    path = str(tmp_path / "packed")
    rows = [(f"run {k}", f'line one\nline "{k}"') for k in range(500)] + [("empty", ""), (None, "no key"), ("none", None)]
    io.write_packed(spark.createDataFrame(rows, "k string, t string"), path, "k", "t", shards=8)
    assert len(glob.glob(f"{path}/**/*.json", recursive=True)) <= 8
    assert sorted(map(tuple, io.read_packed(spark, path).collect()), key=str) == sorted(rows, key=str)
    one = io.read_packed(spark, path, "run 77")
    assert [tuple(r) for r in one.collect()] == [rows[77]] and len(one.inputFiles()) <= 8
    plan = one._jdf.queryExecution().simpleString()
    assert "PartitionFilters: [" in plan and "pmod" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert dict(map(tuple, io.scan_run_summaries(spark, path, packed=True).collect()))["run 3"] == rows[3][1]
