"""Latency queries: ingress lookup, onset and ready times, percentiles, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.operators import backlog as B
from utterlake.operators import gates as G
from utterlake.operators import joins as J
from utterlake.operators import latency as L
from utterlake.operators import metrics as M
from utterlake.plans import fixtures as fx
from utterlake.plans.registry import query

KEY = ["stream"]


def stepped(spark, sf):
    return L.steps(fx.live(spark, sf), fx.mark(spark, sf), KEY, "seq")


def segments(spark, sf):
    return L.segment_latencies(stepped(spark, sf), fx.mark(spark, sf), KEY, "seq")


@query(
    "jn6_forward_asof_join",
    """SELECT p.stream, p.seq, p.kind, p.probe, m.received_at FROM v_probe p
    ASOF LEFT JOIN v_ev m ON m.stream = p.stream AND greatest(1, p.probe) <= m.cursor""",
)
def _(spark, sf):
    marks = fx.ev(spark, sf).select("stream", "cursor", "received_at")
    probes = fx.probe(spark, sf).drop("ready_at")
    return J.asof_forward(probes, marks, KEY, "probe", "cursor", "received_at")


@query("wn9_ingest_cursor", "SELECT stream, seq, cursor - n_samples AS start_cursor, cursor FROM v_ev")
def _(spark, sf):
    d = J.ingest_cursor(fx.ingress(spark, sf), KEY, "seq", "n_samples")
    return d.select("stream", "seq", "start_cursor", "cursor")


@query(
    "wn10_draft_ready_latency",
    """SELECT stream, seq, round(greatest(0, (ready_at - ingress_at) * 1000), 3) AS ms FROM v_step
    WHERE hypothesis <> prev_hypothesis AND ingress_at IS NOT NULL""",
)
def _(spark, sf):
    return L.draft_ready(stepped(spark, sf)).select("stream", "seq", F.round("ms", 3).alias("ms"))


@query(
    "wn11_onset_latency",
    """SELECT stream, segment_no, round(greatest(0, (draft_at - start_ingress) * 1000), 3) AS draft_ms,
      round(greatest(0, (merged_at - start_ingress) * 1000), 3) AS merged_ms FROM v_first WHERE draft_at IS NOT NULL""",
)
def _(spark, sf):
    d = segments(spark, sf).where("draft_at is not null")
    return d.select("stream", "segment_no", F.round("draft_ms", 3).alias("draft_ms"), F.round("merged_ms", 3).alias("merged_ms"))


@query(
    "wn12_final_confirmed_latency",
    """SELECT s.stream, s.segment_no, round(greatest(0, (s.ready_at - s.ingress_at) * 1000), 3) AS ready_ms,
      round(greatest(0, (f.final_at - f.start_ingress) * 1000), 3) AS onset_ms
    FROM v_spoken s JOIN v_first f USING (stream, segment_no) WHERE s.is_flush AND s.confirmed <> s.prev_confirmed AND s.ingress_at IS NOT NULL""",
)
def _(spark, sf):
    onset = F.when(F.col("final_at").isNotNull(), F.round("final_ms", 3)).alias("onset_ms")
    return segments(spark, sf).where("known is not null").select("stream", "segment_no", F.round("ready_ms", 3).alias("ready_ms"), onset)


@query(
    "wn13_end_of_stream",
    """SELECT stream, segment_no, round(pending_ms, 3) AS pending_ms, round(pending_ready_ms, 3) AS pending_ready_ms FROM v_pending""",
)
def _(spark, sf):
    d = segments(spark, sf).where("pending_ms is not null")
    return d.select("stream", "segment_no", *[F.round(c, 3).alias(c) for c in ("pending_ms", "pending_ready_ms")])


@query(
    "wn15_rolling_last_n",
    """SELECT stream, seq, value AS current, round(avg(value) OVER w, 10) AS mean, round(quantile_cont(value, 0.95) OVER w, 10) AS p95
    FROM v_ev WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    d = L.rolling_stats(fx.ingress(spark, sf), KEY, "seq", F.col("value"), 256)
    return d.select("stream", "seq", "current", *[F.round(c, 10).alias(c) for c in ("mean", "p95")])


@query(
    "wn16_running_rtfx",
    """SELECT stream, seq, round(sum(n_samples / 16000.0::DOUBLE) OVER w / greatest(sum(value / 1000.0::DOUBLE) OVER w, 1e-9), 5) AS rtfx
    FROM v_ev WINDOW w AS (PARTITION BY stream ORDER BY seq)""",
)
def _(spark, sf):
    d = L.running_rtfx(
        fx.ingress(spark, sf), KEY, "seq", F.col("n_samples") / 16000.0, F.col("value") / 1000.0
    )
    return d.select("stream", "seq", F.round("rtfx", 5).alias("rtfx"))


@query(
    "ag7_percentile_linear",
    """SELECT stream, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99
    FROM v_ev GROUP BY stream UNION ALL
    SELECT -1, round(quantile_cont(value, 0.5), 5), round(quantile_cont(value, 0.95), 5), round(quantile_cont(value, 0.99), 5) FROM v_ev""",
)
def _(spark, sf):
    d = fx.ingress(spark, sf)
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    per = M.exact_percentiles(d, KEY, "value", wanted)
    whole = M.exact_percentiles(d, [], "value", wanted).withColumn("stream", F.lit(-1).cast("bigint"))
    return per.unionByName(whole).select("stream", *[F.round(c, 5).alias(c) for c in wanted])


@query(
    "ag8_latency_stats",
    """SELECT op AS stage, round(quantile_cont(cost, 0.5), 5) AS median, round(quantile_cont(cost, 0.95), 5) AS p95,
      round(count(*) / (sum(cost) / 1000.0::DOUBLE), 5) AS per_sec FROM v_ops GROUP BY op""",
)
def _(spark, sf):
    d = fx.ops(spark, sf).withColumnRenamed("op", "stage")
    stats = L.latency_stats(d, ["stage"], "cost")
    rate = d.groupBy("stage").agg((F.count("*") / (F.sum("cost") / 1000.0)).alias("per_sec"))
    return stats.join(rate, "stage").select("stage", *[F.round(c, 5).alias(c) for c in ("median", "p95", "per_sec")])


#: Eight chunks of a stream wait together; what shed() leaves of them is worked on.
TOTALS_SQL = """(SELECT count(*) * 0.32::DOUBLE AS audio_sec, sum(0.02::DOUBLE * (k % 7)) AS infer_sec,
   (SELECT sum(last) FROM (SELECT max(ready_at) AS last FROM v_step GROUP BY stream)) AS wall_sec,
   count(*) FILTER (WHERE confirmed = prev_confirmed AND hypothesis <> prev_hypothesis AND prev_hypothesis <> '') AS corrections,
   max((k % 5) * 0.05::DOUBLE) AS max_queue_sec,
   (SELECT CAST(sum(CASE WHEN n > 3 THEN 2 ELSE n END) AS BIGINT) FROM (SELECT count(*) AS n FROM v_step GROUP BY stream, (k - 1) // 8)) AS processed FROM v_step)"""


def summary(spark, sf):
    steps = stepped(spark, sf)
    return L.realtime_summary(L.series(steps, fx.mark(spark, sf), KEY, "seq"), totals(steps))


def totals(steps):
    """One row of sums over all streams."""
    queue = steps.select("stream", "k", F.floor((F.col("k") - 1) / 8).alias("wait"))
    shed = B.shed(queue, ["stream", "wait"], "k", soft=3, target=1, context=2, hard=6)
    kept = shed.agg(F.count_if("kept").alias("processed"), F.count_if(~F.col("kept")).alias("dropped"))
    wall = steps.groupBy("stream").agg(F.max("ready_at").alias("last")).agg(F.sum("last").alias("wall_sec"))
    sums = steps.agg(
        (F.count("*") * F.lit(0.32)).alias("audio_sec"),
        F.sum(F.lit(0.02) * (F.col("k") % 7)).alias("infer_sec"),
        F.count_if(L.corrected()).alias("corrections"),
        F.max((F.col("k") % 5) * F.lit(0.05)).alias("max_queue_sec"),
    )
    return sums.crossJoin(F.broadcast(wall)).crossJoin(F.broadcast(kept))  # one row each


NAMES = ("draft_first_token", "merged_first_token", "final_confirmed", "draft_ready", "final_ready")


def pick_sql(name: str) -> str:
    f = f"FILTER (WHERE series = '{name}')"
    return f"round(avg(ms) {f}, 3) AS {name}_avg, round(quantile_cont(ms, 0.95) {f}, 3) AS {name}_p95"


@query(
    "ag18_realtime_summary",
    f"""SELECT s.*, coalesce(draft_first_token_avg, merged_first_token_avg) AS first_token_avg, coalesce(draft_first_token_p95, merged_first_token_p95) AS first_token_p95,
      round(t.corrections / t.audio_sec * 60, 4) AS corrections_per_min, round(t.audio_sec / t.infer_sec, 4) AS infer_rtfx,
      round(t.audio_sec / t.wall_sec, 4) AS wall_rtfx, round(t.max_queue_sec, 4) AS max_queue_sec, t.corrections, t.processed, (SELECT count(*) FROM v_step) - t.processed AS dropped
    FROM (SELECT {', '.join(pick_sql(n) for n in NAMES)} FROM v_series) s, {TOTALS_SQL} t""",
)
def _(spark, sf):
    d = summary(spark, sf)
    ms = [f"{n}_{k}" for n in (*NAMES, "first_token") for k in ("avg", "p95")]
    rest = ("corrections_per_min", "infer_rtfx", "wall_rtfx", "max_queue_sec")
    return d.select(*[F.round(c, 3).alias(c) for c in ms], *[F.round(c, 4).alias(c) for c in rest], "corrections", "processed", "dropped")


@query(
    "ag19_pass_fail_gates",
    f"""SELECT queue <= 0.5 AS pass_queue, coalesce(first, 'Infinity'::DOUBLE) <= 300 AS pass_first_token, coalesce(final, 'Infinity'::DOUBLE) <= 1700 AS pass_final_confirmed,
      queue <= 0.5 AND coalesce(first, 'Infinity'::DOUBLE) <= 300 AS pass
    FROM (SELECT quantile_cont(ms, 0.95) FILTER (WHERE series = 'draft_first_token') AS first, quantile_cont(ms, 0.95) FILTER (WHERE series = 'final_confirmed') AS final FROM v_series),
         (SELECT max_queue_sec AS queue FROM {TOTALS_SQL})""",
)
def _(spark, sf):
    d = summary(spark, sf)
    return d.select(
        *G.realtime_gates(F.col("max_queue_sec"), F.col("first_token_p95"), F.col("final_confirmed_p95"))
    )
