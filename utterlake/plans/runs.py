"""Run, sweep, trace, profile and placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.functions import arrays as A
from utterlake.operators import joins as J
from utterlake.operators import metrics as M
from utterlake.operators import sweep as W
from utterlake.plans import fixtures as fx
from utterlake.plans.registry import query

AGG_SQL = """(SELECT stride, count(*) AS run_count, bool_and(sha = canonical) AS exact_match_all, bool_and(consistent) AS baseline_consistent,
    avg(infer_rtfx) AS infer_rtfx_mean, min(infer_rtfx) AS infer_rtfx_min, max(corrections) AS corrections_max, CAST(sum(corrections) AS BIGINT) AS corrections_total,
    avg(primary_ms) AS primary_mean, stddev_pop(primary_ms) AS primary_stdev, avg(p95_ms) AS p95_mean
  FROM (SELECT *, sha1(text) AS sha FROM v_sweep),
       (SELECT arg_min(sha1(text), repetition) AS canonical, count(DISTINCT sha1(text)) = 1 AS consistent FROM v_sweep WHERE stride = 0.25)
  GROUP BY stride)"""
REASONS_SQL = """array_to_string(list_filter([CASE WHEN NOT exact_match_all THEN 'confirmed transcript mismatch' END,
  CASE WHEN infer_rtfx_min IS NULL OR infer_rtfx_min < 1.2 THEN 'infer_rtfx < 1.2' END,
  CASE WHEN corrections_max > 0 THEN 'corrections > 0' END,
  CASE WHEN NOT baseline_consistent THEN 'baseline transcript unstable across repetitions' END], lambda x: x IS NOT NULL), '; ')"""


@query(
    "ag13_sweep_aggregate",
    f"""SELECT stride, run_count, exact_match_all, round(infer_rtfx_mean, 6) AS infer_rtfx_mean, round(infer_rtfx_min, 6) AS infer_rtfx_min,
      corrections_max, corrections_total, round(primary_mean, 5) AS primary_mean, round(primary_stdev, 5) AS primary_stdev, round(p95_mean, 5) AS p95_mean,
      {REASONS_SQL} = '' AS pass, {REASONS_SQL} AS fail_reasons FROM {AGG_SQL}""",
)
def _(spark, sf):
    d = W.sweep_aggregate(fx.sweep(spark, sf), 0.25)
    return d.select(
        "stride", "run_count", "exact_match_all",
        F.round("infer_rtfx_mean", 6).alias("infer_rtfx_mean"), F.round("infer_rtfx_min", 6).alias("infer_rtfx_min"),
        "corrections_max", "corrections_total",
        *[F.round(c, 5).alias(c) for c in ("primary_mean", "primary_stdev", "p95_mean")],
        "pass", F.array_join("fail_reasons", "; ").alias("fail_reasons"),
    )


@query(
    "ag14_baseline_consistency",
    """SELECT stride, count(DISTINCT sha1(text)) = 1 AS consistent, count(*) AS runs FROM v_sweep GROUP BY stride""",
)
def _(spark, sf):
    d = fx.sweep(spark, sf)
    return d.groupBy("stride").agg(
        (F.count_distinct(F.sha1("text")) == 1).alias("consistent"), F.count("*").alias("runs")
    )


@query(
    "jn9_baseline_cross_gate",
    """SELECT stride, repetition, sha1(text) = canonical AS exact_match, consistent AS baseline_consistent
    FROM v_sweep, (SELECT arg_min(sha1(text), repetition) AS canonical, count(DISTINCT sha1(text)) = 1 AS consistent FROM v_sweep WHERE stride = 0.25)""",
)
def _(spark, sf):
    d = W.with_exact_match(fx.sweep(spark, sf), 0.25)
    return d.select("stride", "repetition", "exact_match", "baseline_consistent")


FRONTIER_SQL = f"""(SELECT *, row_number() OVER (ORDER BY -infer_rtfx_min, p95_mean, primary_mean, stride) AS rank
  FROM (SELECT *, min(primary_mean) OVER () + 5 AS cutoff FROM {AGG_SQL} WHERE exact_match_all AND infer_rtfx_min >= 1.2 AND corrections_max <= 1)
  WHERE primary_mean <= cutoff)"""


def frontier(spark, sf):
    return W.recommend(W.sweep_aggregate(fx.sweep(spark, sf), 0.25, max_corrections=1), 5.0)


@query(
    "tk2_frontier_recommendation",
    f"SELECT stride, rank, rank = 1 AS recommended, round(primary_mean, 5) AS primary_mean, round(cutoff, 5) AS cutoff FROM {FRONTIER_SQL}",
)
def _(spark, sf):
    return frontier(spark, sf).select(
        "stride", F.col("rank").cast("bigint").alias("rank"), "recommended",
        F.round("primary_mean", 5).alias("primary_mean"), F.round("cutoff", 5).alias("cutoff"),
    )


@query(
    "se3_baseline_first_union",
    """SELECT stride, coalesce(min(ord) FILTER (WHERE ord >= 0), -1) AS ord FROM
      (SELECT 0.1::DOUBLE AS stride, -1 AS ord UNION ALL SELECT stride, CAST(stride * 4 AS BIGINT) FROM v_sweep) GROUP BY stride""",
)
def _(spark, sf):
    strides = fx.sweep(spark, sf).select("stride", (F.col("stride") * 4).cast("bigint").alias("ord"))
    return W.with_baseline_first(strides, 0.1)


def reported(spark, sf):
    d = fx.man(spark, sf)
    summaries = d.select("run_name", fx.summary_json().alias("summary")).where(F.col("summary").isNotNull())
    return W.manifest_report(d.select("dataset", "profile", "run_name", "status"), summaries)


REPORT_SQL = """(SELECT dataset, profile, run_name, CASE WHEN status = 'ok' AND n IS NULL THEN 'missing_summary' WHEN status = 'ok' AND broken THEN 'invalid_summary' ELSE status END AS status,
   CASE WHEN status = 'ok' AND n IS NOT NULL AND NOT broken THEN wer END AS wer, CASE WHEN status = 'ok' AND n IS NOT NULL AND NOT broken THEN rtf END AS rtf,
   CASE WHEN status = 'ok' AND n IS NOT NULL AND NOT broken THEN n END AS num_samples,
   CASE WHEN status = 'ok' AND n % 2 = 0 AND NOT broken THEN n * 2.5::DOUBLE END AS speed_x, CASE WHEN status = 'ok' AND NOT broken THEN n * 10.0::DOUBLE END AS total_audio_sec,
   CASE WHEN status = 'ok' AND NOT broken THEN n * 0.5::DOUBLE END AS total_prediction_sec FROM v_man)"""


@query(
    "jn8_manifest_summaries",
    f"SELECT dataset, profile, run_name, status, round(wer, 6) AS wer, round(rtf, 6) AS rtf, num_samples, speed_x, total_audio_sec, total_prediction_sec FROM {REPORT_SQL}",
)
def _(spark, sf):
    return reported(spark, sf).withColumn("wer", F.round("wer", 6)).withColumn("rtf", F.round("rtf", 6))


@query(
    "ag17_run_matrix_totals",
    f"""SELECT dataset, profile, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed
    FROM {REPORT_SQL} GROUP BY ROLLUP (dataset, profile)""",
)
def _(spark, sf):
    return W.matrix_totals(reported(spark, sf))


@query(
    "tk4_ranked_pick",
    """SELECT dataset, run_name AS picked FROM (SELECT dataset, run_name, row_number() OVER (PARTITION BY dataset ORDER BY NOT contains(run_name, '77'), length(run_name), run_name) AS rn FROM v_man) WHERE rn = 1""",
)
def _(spark, sf):
    return W.ranked_pick(fx.man(spark, sf), ["dataset"], "run_name", "77")


@query("se4_failing_except", f"SELECT run_name FROM {REPORT_SQL} EXCEPT ALL SELECT run_name FROM {REPORT_SQL} WHERE status = 'ok'")
def _(spark, sf):
    d = reported(spark, sf)
    return d.select("run_name").exceptAll(d.where("status = 'ok'").select("run_name"))


def trace_pairs(spark, sf):
    t = fx.trace(spark, sf)
    return J.positional(t.where("side = 'a'"), t.where("side = 'b'"), ["trace", "idx"], ["k1", "k2"])


PAIRS_SQL = """(SELECT coalesce(a.trace, b.trace) AS trace, coalesce(a.idx, b.idx) AS idx, a.k1 AS a_k1, a.k2 AS a_k2, b.k1 AS b_k1, b.k2 AS b_k2, a.trace IS NOT NULL AS ha, b.trace IS NOT NULL AS hb
  FROM (SELECT * FROM v_trace WHERE side = 'a') a FULL OUTER JOIN (SELECT * FROM v_trace WHERE side = 'b') b ON a.trace = b.trace AND a.idx = b.idx)"""
DIFF_SQL = f"""(SELECT trace, count(*) FILTER (WHERE ha) AS a_len, count(*) FILTER (WHERE hb) AS b_len,
   coalesce(min(idx) FILTER (WHERE ha AND hb AND (a_k1 IS DISTINCT FROM b_k1 OR a_k2 IS DISTINCT FROM b_k2)),
     CASE WHEN count(*) FILTER (WHERE ha) <> count(*) FILTER (WHERE hb) THEN least(count(*) FILTER (WHERE ha), count(*) FILTER (WHERE hb)) END) AS first_diff
  FROM {PAIRS_SQL} GROUP BY trace)"""


@query("jn4_positional_full_outer", f"SELECT trace, idx, a_k1, a_k2, b_k1, b_k2 FROM {PAIRS_SQL}")
def _(spark, sf):
    return trace_pairs(spark, sf).drop("has_a", "has_b")


@query("wn17_first_divergence", f"SELECT trace, a_len, b_len, first_diff FROM {DIFF_SQL}")
def _(spark, sf):
    return J.first_divergence(trace_pairs(spark, sf), "trace", ["k1", "k2"])


@query(
    "jn5_neighbourhood_range_join",
    f"""SELECT p.trace, p.idx, d.first_diff, a_k1, a_k2, b_k1, b_k2 FROM {PAIRS_SQL} p JOIN {DIFF_SQL} d ON p.trace = d.trace
    AND p.idx BETWEEN d.first_diff - 3 AND d.first_diff + 3""",
)
def _(spark, sf):
    pairs = trace_pairs(spark, sf)
    diffs = J.first_divergence(pairs, "trace", ["k1", "k2"])
    return J.neighbourhood(pairs, diffs, "trace", 3).drop("has_a", "has_b")


@query("tk7_compare_cap", "SELECT trace, side, count(*) AS n, CAST(sum(k2) AS BIGINT) AS total FROM v_trace WHERE idx < 10 GROUP BY trace, side")
def _(spark, sf):
    d = fx.trace(spark, sf).where(F.col("idx") < 10)
    return d.groupBy("trace", "side").agg(F.count("*").alias("n"), F.sum("k2").alias("total"))


STAGES = ("feature", "prepare", "predict", "decode", "merge")
COUNTS = "encoder_windows encoder_reused encoder_computed reuse_steps compute_steps decoder_windows resumed_windows resumed_tokens predict_calls advance_calls emitted blanks".split()
RATIOS = {
    "window_reuse_ratio": ("encoder_reused", "encoder_windows"),
    "step_reuse_ratio": ("reuse_steps", "reuse_steps + compute_steps"),
    "windows_per_call": ("decoder_windows", "1"),
    "predicts_per_call": ("predict_calls", "1"),
    "predicts_per_window": ("predict_calls", "decoder_windows"),
    "predicts_per_token": ("predict_calls", "emitted"),
    "advance_ratio": ("advance_calls", "predict_calls"),
}


def profile_sql(cond: str) -> str:
    """Each figure straight from the rows of a call; sum(1) is the number of calls."""
    f = f"FILTER (WHERE {cond})"
    cols = [f"count(*) {f} AS calls"]
    for c in ("total_ms", *[f"{s}_ms" for s in STAGES], "requested_frames", "copied_frames"):
        cols.append(f"round(avg({c}) {f}, 10) AS avg_{c}")
    cols += [f"round(sum({s}_ms) {f} / greatest(sum(total_ms) {f}, 1e-9), 10) AS share_{s}" for s in STAGES]
    cols += [f"CAST(sum({c}) {f} AS BIGINT) AS {c}_total" for c in COUNTS]
    cols += [f"round(sum({a}) {f} / greatest(sum({b}) {f}, 1), 10) AS {name}" for name, (a, b) in RATIOS.items()]
    return ", ".join(cols)


def rounded(d):
    return d.select(*[c if c in ("stream", "calls") or c.endswith("_total") else F.round(c, 10).alias(c) for c in d.columns])


@query("ag11_profile_rollup", f"SELECT stream, {profile_sql('true')} FROM v_prof GROUP BY stream")
def _(spark, sf):
    return rounded(M.profile_rollup(fx.prof(spark, sf), ["stream"]))


@query(
    "ag12_tail_half_rollup",
    f"""SELECT stream, {profile_sql('cursor_sec >= total / 2')} FROM (SELECT *, max(cursor_sec) OVER (PARTITION BY stream) AS total FROM v_prof) GROUP BY stream""",
)
def _(spark, sf):
    d = fx.prof(spark, sf)
    ends = d.groupBy("stream").agg(F.max("cursor_sec").alias("total"))
    d = d.join(ends, "stream")
    return rounded(M.profile_rollup(d, ["stream"], tail_from=F.col("cursor_sec") >= F.col("total") / 2))


@query("ag15_op_histogram", "SELECT op, count(*) AS n FROM v_ops GROUP BY op ORDER BY op")
def _(spark, sf):
    return fx.ops(spark, sf).groupBy("op").agg(F.count("*").alias("n")).orderBy("op")


@query(
    "ag16_placement_rollup",
    """SELECT level, op, device, signature, ops, cpu_only, round(cost, 3) AS cost, round(CASE WHEN sum(cost) OVER (PARTITION BY level) > 0 THEN cost / sum(cost) OVER (PARTITION BY level) ELSE 0 END, 6) AS share
    FROM (SELECT CASE WHEN grouping(device) = 0 AND grouping(op) = 0 THEN 'op_device' WHEN grouping(device) = 0 THEN 'device' ELSE 'signature' END AS level, op, device, signature, count(*) AS ops, sum(cost) AS cost, count(*) FILTER (WHERE support = ['CPU']) AS cpu_only
      FROM (SELECT *, array_to_string(support, ',') AS signature FROM v_ops) GROUP BY GROUPING SETS ((device), (signature), (op, device)))""",
)
def _(spark, sf):
    d = M.placement_rollup(fx.ops(spark, sf))
    return d.withColumn("cost", F.round("cost", 3)).withColumn("share", F.round("share", 6))


@query(
    "tk3_top_groups",
    "SELECT op, device, count(*) AS n FROM v_ops GROUP BY op, device ORDER BY n DESC, op, device LIMIT 5",
)
def _(spark, sf):
    d = fx.ops(spark, sf).groupBy("op", "device").agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "op", "device").limit(5)


ABS_SQL = "(SELECT vec_id, label, abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings)"
SCORES_SQL = """quantile_cont(x, 0.999) / (quantile_cont(x, 0.99) + 1e-8) AS outlier, max(x) / (quantile_cont(x, 0.95) + 1e-8) AS range_score,
  stddev_pop(x) / (avg(x) + 1e-8) AS std_score"""


@query(
    "pj15_mixed_score",
    f"SELECT vec_id, round(outlier, 6) AS outlier, round(range_score, 6) AS range_score, round(std_score, 6) AS std_score FROM (SELECT vec_id, {SCORES_SQL} FROM {ABS_SQL} GROUP BY vec_id)",
)
def _(spark, sf):
    e = F.col("embedding")
    return fx.table(spark, sf, "embeddings").select(
        "vec_id",
        *[F.round(A.mixed_score(e, k), 6).alias(n) for k, n in (("outlier", "outlier"), ("range", "range_score"), ("std", "std_score"))],
    )


@query(
    "pj16_stride_sample",
    """SELECT vec_id, len(s) AS n, round(list_sum(s), 6) AS total FROM (SELECT vec_id, list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x, i: (i - 1) % 6 = 0)[1:10] AS s FROM embeddings)""",
)
def _(spark, sf):
    s = A.stride_sample(F.col("embedding").cast("array<double>"), 10)
    d = fx.table(spark, sf, "embeddings").select("vec_id", s.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x)
    return d.select("vec_id", F.size("s").cast("bigint").alias("n"), F.round(total, 6).alias("total"))


@query(
    "ag10_grouped_outlier_scores",
    f"SELECT label, n, round(outlier, 6) AS outlier, round(range_score, 6) AS range_score, round(std_score, 6) AS std_score FROM (SELECT label, count(*) AS n, {SCORES_SQL} FROM {ABS_SQL} GROUP BY label)",
)
def _(spark, sf):
    d = fx.table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v"))
    d = d.select("label", F.abs(F.col("v").cast("double")).alias("x"))
    out = M.grouped_scores(d, ["label"], "x")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("outlier", "range_score", "std_score")])


@query(
    "wn18_cumulative_budget_pick",
    f"""SELECT vec_id, CASE WHEN first THEN 'fp16' WHEN sum(CASE WHEN first THEN 0 ELSE 64 END) OVER (ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING) - 64 < floor(total * 0.3::DOUBLE) THEN 'high' ELSE 'low' END AS tier
    FROM (SELECT *, sum(64) OVER (ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING) - 64 < floor(total * 0.1::DOUBLE) AS first
      FROM (SELECT vec_id, round(std_score, 9) AS score, (SELECT count(*) * 64 FROM embeddings) AS total FROM (SELECT vec_id, {SCORES_SQL} FROM {ABS_SQL} GROUP BY vec_id)))""",
)
def _(spark, sf):
    d = fx.table(spark, sf, "embeddings").select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("numel"),
        F.round(A.mixed_score(F.col("embedding"), "std"), 9).alias("score"),
    )
    return M.budget_pick(d, [], "vec_id", "numel", "score", {"fp16": 0.1, "high": 0.3}).select("vec_id", "tier")


@query(
    "jn7_vocabulary_join",
    """SELECT stream, seq, kind, pos, t.id, CASE WHEN t.id = 0 THEN '<blank>' WHEN piece IS NULL THEN '<invalid>' ELSE piece END AS piece
    FROM (SELECT stream, seq, kind, unnest(next_tokens) AS id, unnest(range(len(next_tokens))) AS pos FROM v_tok) t LEFT JOIN v_vocab USING (id)""",
)
def _(spark, sf):
    d = fx.tok(spark, sf).select("stream", "seq", "kind", F.posexplode("next_tokens").alias("pos", "id"))
    out = J.with_pieces(d, fx.vocab(spark, sf), "id", 0)
    return out.select("stream", "seq", "kind", F.col("pos").cast("bigint").alias("pos"), "id", "piece")


@query(
    "ag23_grouped_token_text",
    "SELECT stream, seq, string_agg(word, ' ' ORDER BY pos) AS text FROM v_word GROUP BY stream, seq",
)
def _(spark, sf):
    from utterlake.operators.tokens import joined

    return joined(fx.word(spark, sf), ["stream", "seq"], "pos", "word", "text", " ")


@query(
    "tk5_keep_best_top_n",
    """SELECT stream, hyp, last_frame, prev, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, hyp, last_frame, prev) AS rank
      FROM (SELECT stream, array_to_string(tokens, ',') AS hyp, len(tokens) % 4 AS last_frame, tokens[1] AS prev, max(-seq / 10.0::DOUBLE) AS score FROM v_tok GROUP BY ALL)) WHERE rank <= 4""",
)
def _(spark, sf):
    d = fx.tok(spark, sf).select(
        "stream",
        F.array_join(F.col("tokens").cast("array<string>"), ",").alias("hyp"),
        (F.size("tokens") % 4).cast("bigint").alias("last_frame"),
        F.get("tokens", F.lit(0)).alias("prev"),
        (-F.col("seq") / 10.0).alias("score"),
    )
    out = W.keep_best(d, ["stream"], ["hyp", "last_frame", "prev"], "score", 4)
    return out.withColumn("rank", F.col("rank").cast("bigint"))
