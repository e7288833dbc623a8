"""File round trips: each query writes what Spark derives from the given tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.functions import signal as G
from utterlake.operators import sweep as W
from utterlake.plans import fixtures as fx
from utterlake.plans.registry import query
from utterlake.plans.runs import AGG_SQL, FRONTIER_SQL, REASONS_SQL, REPORT_SQL, frontier
from utterlake.session import scratch
from utterlake.sources import io


@query(
    "sc1_scan_utterances",
    """SELECT id, text, round(audio_sec, 4) AS audio_sec, infer_sec FROM (
      SELECT r.id, CASE WHEN r.turn = 1 THEN 'again ' || r.text ELSE r.text END AS text, h.audio_sec, CASE WHEN r.turn % 2 = 0 THEN NULL ELSE 1.5::DOUBLE END AS infer_sec
      FROM v_ref r LEFT JOIN v_hyp h USING (id))""",
)
def _(spark, sf):
    d = fx.ref(spark, sf).join(fx.hyp(spark, sf).select("id", "audio_sec"), "id", "left")
    d = d.withColumn("infer_sec", F.when(F.col("turn") % 2 != 0, 1.5))
    # An order that no length of a conversation can break: the second reading of a line comes after the first.
    first = d.withColumn("ordinal", F.shiftleft("conv_id", 32) + F.col("turn") * 2)
    again = first.where("turn = 1").withColumn("ordinal", F.col("ordinal") + 1)
    again = again.withColumn("text", F.concat(F.lit("again "), "text"))
    cols = ["ordinal", "id", "text", "audio_sec", "infer_sec"]
    path = scratch(spark, "utterances")
    lines = first.select(cols).unionByName(again.select(cols)).select(F.to_json(F.struct("*")).alias("value"))
    junk = d.where("turn = 0").select(F.explode(F.array(F.lit("{broken"), F.lit("\u00a0"))).alias("value"))
    io.write_lines(lines.unionByName(junk), path)
    out = io.scan_utterances(spark, path, rejects=scratch(spark, "rejects"))
    return out.select("id", "text", F.round("audio_sec", 4).alias("audio_sec"), "infer_sec")


@query(
    "sc2_scan_manifest_samples",
    "SELECT CAST(utt AS VARCHAR) AS id, len(samples) / 16000.0::DOUBLE AS audio_sec, round(list_sum(samples), 6) AS total FROM v_sig",
)
def _(spark, sf):
    d = fx.sig(spark, sf)
    rows = d.select(
        F.col("utt").alias("ordinal"),
        F.when(F.col("utt") % 2 == 0, F.col("utt").cast("string")).alias("id"),
        F.lit("").alias("text"),
        F.lit(16000).alias("sampling_rate"),
        F.col("samples").alias("array"),
    )
    path = scratch(spark, "samples")
    io.write_jsonl(rows, path)
    total = F.aggregate("array", F.lit(0.0), lambda acc, x: acc + x)
    return io.scan_manifest_samples(spark, path).select("id", "audio_sec", F.round(total, 6).alias("total"))


@query("sc3_scan_dataset", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS reference FROM documents")
def _(spark, sf):
    return io.scan_dataset(spark, f"{sf}/documents.parquet", ordinal="doc_id").select("id", "reference")


SPOKEN_SQL = """(SELECT file, ordinal, start_sec, t AS text, max(CASE WHEN start_sec >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ordinal) AS stopped
   FROM v_lines WHERE form < 4)"""


@query(
    "sc4_scan_speaker_lines",
    f"SELECT file, string_agg(text, ' ' ORDER BY ordinal) AS text FROM {SPOKEN_SQL} WHERE stopped = 0 AND text <> '' GROUP BY file",
)
def _(spark, sf):
    from utterlake.operators.tokens import joined

    path = scratch(spark, "lines")
    d = fx.lines(spark, sf).repartition("file").sortWithinPartitions("file", "ordinal")
    io.write_texts(d, path, "file", "line")
    # A file's lines up to the limit are one transcript.
    return joined(io.scan_speaker_lines(spark, path, 15.0), ["file"], "ordinal", "text", "text", " ")


@query(
    "wn22_take_while",
    """SELECT file, ordinal FROM (SELECT file, ordinal, max(CASE WHEN start_sec >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ordinal) AS stopped FROM v_lines) WHERE stopped = 0""",
)
def _(spark, sf):
    d = io.take_while(fx.lines(spark, sf), ["file"], "ordinal", F.col("start_sec") >= 15)
    return d.select("file", "ordinal")


#: The fields of a decoder step over the rows of a trace, in SQL that both engines take.
STEP = {
    "chunk_index": "(idx - idx % 10) / 10",
    "step_index": "idx",
    "encoder_steps": "100 + idx % 7",
    "t": "idx * 2",
    "token_id": "k2",
    "duration_idx": "idx % 5",
    "duration_value": "idx % 5",
    "skip": "idx % 5",
    "prev_token": "event_id % 97",
    "token_piece": "k1",
    "emitted": "k2 % 7 <> 0",
    "commit_state": "idx % 2",
}
LONGS = [c for c in STEP if c not in ("token_piece", "emitted", "commit_state")]


@query(
    "sc5_scan_trace",
    f"""SELECT side AS source, trace, {', '.join(f"CAST({STEP[c]} AS BIGINT) AS {c}" for c in LONGS)}, k1 AS token_piece, {STEP['emitted']} AS emitted, CAST({STEP['commit_state']} AS INTEGER) AS commit_state,
      CASE WHEN idx % 3 = 0 THEN k2 + 1 END AS second_token, CASE WHEN idx % 3 = 0 THEN -1.5::DOUBLE END AS second_logp, CASE WHEN idx % 3 = 0 THEN idx % 5 + 1 END AS second_duration
    FROM v_trace WHERE idx % 10 <> 0""",
)
def _(spark, sf):
    fields = [F.expr(f"CAST({STEP[c]} AS BIGINT)" if c in LONGS else STEP[c]).alias(c) for c in STEP]
    entry = lambda **x: F.struct(*[c.alias(k) for k, c in x.items()])
    tokens = F.array(*[entry(token_id=F.col("k2") + i, token_piece=F.col("k1"), logp=F.lit(-0.5 - i)) for i in range(2)])
    durations = F.array(*[entry(duration_idx=F.col("idx") % 5 + i, duration_value=F.col("idx") % 5 + i, logp=F.lit(-0.5 - i)) for i in range(2)])
    # the candidates are written where they were asked for, a third of the steps here
    asked = F.col("idx") % 3 == 0
    kind = F.when(F.col("idx") % 10 == 0, "chunk").otherwise("step").alias("kind")
    d = fx.trace(spark, sf).select("idx", F.struct(F.col("side").alias("source"), kind, "trace", *fields, F.when(asked, tokens).alias("token_topk"), F.when(asked, durations).alias("duration_topk")).alias("s"))
    # Broken, blank and non-object lines ride along.
    junk = F.array(F.to_json("s"), F.when(F.col("idx") == 1, F.lit("{oops")).otherwise("   "), F.lit("[1, 2]"))
    path = scratch(spark, "trace")
    io.write_lines(d.select(F.explode(junk).alias("value")), path)
    second = lambda c, f: F.get(c, F.lit(1))[f]
    return io.scan_trace(spark, path).select(
        "source", "trace", *STEP, second("token_topk", "token_id").alias("second_token"), second("token_topk", "logp").alias("second_logp"), second("duration_topk", "duration_idx").alias("second_duration")
    )


def manifest_files(spark, sf):
    path = scratch(spark, "manifest")
    d = fx.man(spark, sf)
    line = F.concat_ws("\t", "dataset", "profile", "run_name", "status")
    short = F.concat_ws("\t", "dataset", "profile")
    head = spark.range(1).select(F.lit("\t".join(io.MANIFEST_COLUMNS)).alias("value"))
    rows = d.select(F.explode(F.array(line, short)).alias("value"))
    io.write_lines(head.unionByName(rows), path)
    return path


@query("sc6_scan_run_manifest", "SELECT dataset, profile, run_name, status FROM v_man")
def _(spark, sf):
    return io.scan_run_manifest(spark, manifest_files(spark, sf))


@query(
    "sc7_scan_run_summaries",
    f"SELECT dataset, run_name, status, round(wer, 6) AS wer FROM {REPORT_SQL} WHERE status IN ('ok', 'invalid_summary', 'missing_summary')",
)
def _(spark, sf):
    # Run names are many here, so summaries are packed, not kept as one file each.
    d = fx.man(spark, sf)
    path = scratch(spark, "summaries")
    rows = d.select("run_name", fx.summary_json().alias("summary")).where(F.col("summary").isNotNull())
    io.write_packed(rows, path, "run_name", "summary")
    summaries = io.scan_run_summaries(spark, path, packed=True)
    report = W.manifest_report(io.scan_run_manifest(spark, manifest_files(spark, sf)), summaries)
    used = report.where(F.col("status").isin("ok", W.INVALID, W.MISSING))
    return used.select("dataset", "run_name", "status", F.round("wer", 6).alias("wer"))


@query(
    "sc8_scan_text",
    r"""SELECT conv_id AS file, regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\s+', ''), '\s+$', '') AS text
    FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    # One transcript file per conversation; its turns are its lines.
    d = fx.table(spark, sf, "conversations").withColumn("file", F.col("conv_id"))
    d = d.repartition("file").sortWithinPartitions("file", "turn")
    path = scratch(spark, "texts")
    io.write_texts(d, path, "file", "text")
    return io.scan_text(spark, path).withColumn("file", F.col("file").cast("bigint"))


@query("sc9_scan_vocab", "SELECT id, piece FROM v_vocab")
def _(spark, sf):
    v = fx.vocab(spark, sf)
    path = scratch(spark, "vocab")
    # Part files hold consecutive ids, so their names are in id order.
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    io.write_lines(v.repartitionByRange(pieces, "id").sortWithinPartitions("id").select(F.col("piece").alias("value")), path)
    return io.scan_vocab(spark, path)


@query(
    "sc10_scan_audio_arrays",
    "SELECT utt, len(ch0) AS n, round(list_sum(ch0) / 2 + list_sum(ch1) / 2, 6) AS total FROM v_sig2",
)
def _(spark, sf):
    d = fx.sig2(spark, sf).select("utt", F.array("ch0", "ch1").alias("matrix"))
    out = io.scan_audio_arrays(d, "matrix")
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("utt", F.size("samples").cast("bigint").alias("n"), F.round(total, 6).alias("total"))


@query("sk1_jsonl_rows", "SELECT r.id, r.text AS reference, h.hyp_a AS prediction, round(audio_sec, 4) AS audio_length_s FROM v_ref r JOIN v_hyp h USING (id)")
def _(spark, sf):
    from utterlake.plans.scoring import matched

    d = matched(spark, sf).select(
        "id", F.col("ref").alias("reference"), F.col("hyp_a").alias("prediction"), F.col("audio_sec").alias("audio_length_s")
    )
    path = scratch(spark, "predictions")
    io.write_jsonl(d, path)
    back = spark.read.schema(d.schema).json(path)
    return back.withColumn("audio_length_s", F.round("audio_length_s", 4))


@query(
    "sk2_csv_report",
    f"SELECT stride, run_count, {REASONS_SQL} = '' AS pass, exact_match_all, nullif({REASONS_SQL}, '') AS fail_reasons FROM {AGG_SQL}",
)
def _(spark, sf):
    d = W.sweep_aggregate(fx.sweep(spark, sf), 0.25)
    path = scratch(spark, "report")
    io.write_csv_report(d, path, ["stride", "run_count", "pass", "exact_match_all", "fail_reasons"])
    schema = "stride double, run_count bigint, pass boolean, exact_match_all boolean, fail_reasons string"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.withColumn("fail_reasons", F.nullif("fail_reasons", F.lit("")))


@query(
    "sk3_json_summary",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed FROM {REPORT_SQL}",
)
def _(spark, sf):
    from utterlake.plans.runs import reported

    totals = W.matrix_totals(reported(spark, sf)).where("dataset is null and profile is null")
    path = scratch(spark, "summary")
    io.write_json_summary(totals.select("total", "ok", "failed"), path)
    return spark.read.schema("total bigint, ok bigint, failed bigint").json(path)


@query(
    "sk5_text_files",
    """SELECT kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
      SELECT 'confirmed' AS kind, array_to_string(confirmed, ' ') AS text FROM v_state UNION ALL SELECT 'hypothesis', array_to_string(hypothesis, ' ') FROM v_state) GROUP BY kind""",
)
def _(spark, sf):
    d = fx.state(spark, sf)
    both = F.array(
        F.struct(F.lit("confirmed").alias("kind"), F.array_join("confirmed", " ").alias("text")),
        F.struct(F.lit("hypothesis").alias("kind"), F.array_join("hypothesis", " ").alias("text")),
    )
    path = scratch(spark, "final")
    io.write_texts(d.select(F.inline(both)), path, "kind", "text")
    back = spark.read.text(path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query(
    "sk6_recommended_settings",
    f"""SELECT '# latency_equivalence_ms=5.0' AS value UNION ALL
    SELECT '# recommended_stride=' || printf('%.3f', stride) || ' primary_mean=' || printf('%.3f', primary_mean) || ' primary_p95_mean=' || printf('%.3f', p95_mean) || ' infer_rtfx_min=' || printf('%.3f', infer_rtfx_min) FROM {FRONTIER_SQL} WHERE rank = 1
    UNION ALL SELECT 'decode_stride_sec=' || printf('%.3f', stride) FROM {FRONTIER_SQL} WHERE rank = 1""",
)
def _(spark, sf):
    path = scratch(spark, "settings")
    io.write_lines(W.settings_text(frontier(spark, sf), 5.0), path)
    return spark.read.text(path)
