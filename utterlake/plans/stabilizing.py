"""Stabiliser and speech-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.operators import stabilize as S
from utterlake.operators import vad as V
from utterlake.params import VadConfig
from utterlake.plans import fixtures as fx
from utterlake.plans.fixture_sql import draft_tail_sql, lcp_sql, overlap_sql  # noqa: F401
from utterlake.plans.registry import query
from utterlake.session import cut_lineage

SEG = ["stream", "segment"]
VAD = VadConfig(start_dbfs=-20.0, end_dbfs=-30.0, min_speech_ms=640, min_silence_ms=640)


def text(c):
    return F.array_join(c, " ")


def partials(spark, sf):
    return fx.part(spark, sf).where(F.col("action") == "partial")


def frame_sql(n: int) -> str:
    return f"""(SELECT *, list(words) OVER (PARTITION BY stream, segment ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS lists
      FROM v_part WHERE action = 'partial')"""


AGREED2 = f"CASE WHEN len(lists) < 2 THEN CAST([] AS VARCHAR[]) ELSE lists[1][1:{lcp_sql('lists[1]', 'lists[2]')}] END"


@query(
    "wn1_local_agreement",
    f"""SELECT stream, segment, seq, array_to_string(c, ' ') AS confirmed, array_to_string(words[len(c) + 1:], ' ') AS hypothesis
    FROM (SELECT *, {AGREED2} AS c FROM {frame_sql(2)})""",
)
def _(spark, sf):
    d = S.local_agreement(partials(spark, sf), SEG, "seq", "words", 2)
    return d.select(*SEG, "seq", text("confirmed").alias("confirmed"), text("hypothesis").alias("hypothesis"))


@query(
    "wn2_draft_channel",
    f"""SELECT stream, segment, seq, array_to_string(c, ' ') AS confirmed, array_to_string({draft_tail_sql('c', 'd')}, ' ') AS draft
    FROM (SELECT *, CASE WHEN len(lists) < 3 THEN CAST([] AS VARCHAR[])
            ELSE lists[1][1:least({lcp_sql('lists[1]', 'lists[2]')}, {lcp_sql('lists[1]', 'lists[3]')})] END AS c,
            CASE WHEN len(lists) < 2 THEN words ELSE words[1:{lcp_sql('lists[len(lists) - 1]', 'words')}] END AS d FROM {frame_sql(3)})""",
)
def _(spark, sf):
    d = S.draft_channel(partials(spark, sf), SEG, "seq", "words", required=3, draft=2)
    return d.select(*SEG, "seq", text("confirmed").alias("confirmed"), text("hypothesis").alias("draft"))


@query(
    "wn3_segment_flush",
    """SELECT f.stream, f.segment, f.seq, array_to_string(p.words, ' ') AS confirmed
    FROM v_part f JOIN v_part p ON p.stream = f.stream AND p.segment = f.segment AND p.seq = f.seq - 1 WHERE f.action = 'flush'""",
)
def _(spark, sf):
    d = S.flush_rows(fx.part(spark, sf), SEG, "seq", "words", F.col("action") == "flush")
    return d.select(*SEG, "seq", text("confirmed").alias("confirmed"))


MERGED_SQL = "concat_ws(' ', nullif(array_to_string(confirmed, ' '), ''), nullif(array_to_string(hypothesis, ' '), ''))"


@query(
    "wn4_revision_counter",
    f"""SELECT stream, seq, CAST(sum(CASE WHEN m IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS revision
    FROM (SELECT stream, seq, m, lag(m, 1, '') OVER (PARTITION BY stream ORDER BY seq) AS p FROM (SELECT stream, seq, {MERGED_SQL} AS m FROM v_state))""",
)
def _(spark, sf):
    merged = F.array_join(F.concat("confirmed", "hypothesis"), " ")
    return S.revisions(fx.state(spark, sf), ["stream"], "seq", merged).select("stream", "seq", "revision")


@query(
    "wn5_token_churn",
    f"""SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq, part, pos) AS token_id, part, pos, word
    FROM (SELECT stream, seq, 'confirmed' AS part, unnest(range({lcp_sql('pc', 'c')}, len(c))) AS pos, unnest(c[{lcp_sql('pc', 'c')} + 1:]) AS word FROM prev
      UNION ALL SELECT stream, seq, 'hypothesis', unnest(range({lcp_sql('ph', 'h')}, len(h))), unnest(h[{lcp_sql('ph', 'h')} + 1:]) FROM prev)""".replace(
        "FROM prev",
        """FROM (SELECT stream, seq, confirmed AS c, hypothesis AS h, lag(confirmed, 1, CAST([] AS VARCHAR[])) OVER w AS pc, lag(hypothesis, 1, CAST([] AS VARCHAR[])) OVER w AS ph
          FROM v_state WINDOW w AS (PARTITION BY stream ORDER BY seq))""",
    ),
)
def _(spark, sf):
    d = S.stabilize(fx.part(spark, sf), SEG, "seq", "words", F.col("action") == "flush")
    return S.token_churn(d, ["stream"], "segment", "seq", "confirmed", "hypothesis")


def flags(spark, sf):
    d = V.speech_flags(fx.en(spark, sf), ["stream"], "seq", F.col("dbfs"), F.col("frame_ms"), VAD)
    return d.select("stream", "seq", "dbfs", "speech")


@query("wn6_vad_hysteresis", "SELECT stream, seq, speech FROM v_vad")
def _(spark, sf):
    return flags(spark, sf).select("stream", "seq", "speech")


@query(
    "wn7_speech_segments",
    """SELECT stream, seq, speech AND NOT was AS onset, NOT speech AND was AS flush,
      CAST(sum(CASE WHEN speech AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS segment
    FROM (SELECT *, lag(speech, 1, false) OVER (PARTITION BY stream ORDER BY seq) AS was FROM v_vad)""",
)
def _(spark, sf):
    d = V.speech_segments(flags(spark, sf), ["stream"], "seq")
    return d.select("stream", "seq", "onset", "flush", "segment")


TEXT_STATE = "(SELECT stream, segment, seq, action, array_to_string(confirmed, ' ') AS confirmed, array_to_string(hypothesis, ' ') AS hypothesis FROM v_state)"


def texts(spark, sf):
    d = fx.state(spark, sf)
    return d.select(*SEG, "seq", "action", text("confirmed").alias("confirmed"), text("hypothesis").alias("hypothesis"))


@query(
    "wn8_corrections",
    f"""SELECT stream, count(*) FILTER (WHERE confirmed = pc AND hypothesis <> ph AND ph <> '') AS corrections
    FROM (SELECT *, lag(confirmed, 1, '') OVER w AS pc, lag(hypothesis, 1, '') OVER w AS ph FROM {TEXT_STATE} WINDOW w AS (PARTITION BY stream ORDER BY seq))
    GROUP BY stream""",
)
def _(spark, sf):
    from utterlake.operators.latency import correction_count

    d = fx.stable(spark, sf)
    return correction_count(d.select("stream", "seq", text("confirmed").alias("confirmed"), text("hypothesis").alias("hypothesis")), ["stream"], "seq")


@query(
    "wn14_transcript_cursor",
    """SELECT stream, seq, max(CASE WHEN confirmed <> prev_confirmed OR merged <> prev_merged OR is_flush THEN least(total, cursor) / 16000.0::DOUBLE END) OVER (PARTITION BY stream ORDER BY seq) AS transcript_cursor
    FROM v_step JOIN (SELECT stream, max(cursor) AS total FROM v_mark GROUP BY stream) USING (stream)""",
)
def _(spark, sf):
    from utterlake.operators.latency import mark_of

    total = fx.mark(spark, sf).groupBy("stream").agg(F.max("cursor").alias("total"))
    # Only changes of the texts matter, so their marks are what moves.
    marks = {c: mark_of(F.col(c)) for c in ("confirmed", "merged")}
    d = cut_lineage(fx.live(spark, sf).withColumns(marks).select("stream", "seq", "is_flush", "cursor", *marks), "marked")
    d = S.with_previous(d, ["stream"], "seq", dict.fromkeys(marks, mark_of(F.lit(""))))
    changed = (F.col("confirmed") != F.col("prev_confirmed")) | (F.col("merged") != F.col("prev_merged"))
    # A flush moves the cursor also where no text changed; it never passes the audio there is.
    d = d.join(total, "stream").withColumn("cursor_sec", F.least("total", "cursor") / 16000.0)
    return S.transcript_cursor(d, ["stream"], "seq", "cursor_sec", changed | F.col("is_flush")).select("stream", "seq", "transcript_cursor")


@query(
    "wn19_stagnation_run",
    f"""SELECT stream, seq, row_number() OVER (PARTITION BY stream, island ORDER BY seq) - 1 AS stagnant
    FROM (SELECT *, sum(CASE WHEN f = p THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq) AS island
      FROM (SELECT stream, seq, f, lag(f) OVER (PARTITION BY stream ORDER BY seq) AS p
        FROM (SELECT stream, seq, CASE WHEN action = 'partial' THEN confirmed || '|' || hypothesis END AS f
          FROM (SELECT stream, action, confirmed, hypothesis, unnest([seq * 2, seq * 2 + 1]) AS seq FROM {TEXT_STATE}))))""",
)
def _(spark, sf):
    # Every partial text comes twice, so that runs do occur.
    finger = F.concat_ws("|", "confirmed", "hypothesis")
    twice = texts(spark, sf).withColumn("seq", F.explode(F.array(F.col("seq") * 2, F.col("seq") * 2 + 1)))
    d = S.stagnation_run(twice, ["stream"], "seq", finger, F.col("action") == "partial")
    return d.select("stream", "seq", "stagnant")


@query(
    "wn20_chunk_run_flush",
    """SELECT stream, seq, (rn - 1) // 80 AS run, rn % 80 = 0 AS force_flush
    FROM (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq) AS rn FROM v_part WHERE action = 'partial')""",
)
def _(spark, sf):
    return S.chunk_run(partials(spark, sf), ["stream"], "seq", 80).select("stream", "seq", "run", "force_flush")


@query(
    "wn21_consecutive_dedup",
    f"""SELECT stream, seq, confirmed AS text FROM (SELECT *, lag(confirmed) OVER (PARTITION BY stream ORDER BY seq) AS p
      FROM {TEXT_STATE} WHERE confirmed <> '') WHERE confirmed IS DISTINCT FROM p""",
)
def _(spark, sf):
    d = texts(spark, sf).withColumn("text", F.col("confirmed"))
    return S.emit_changes(d, ["stream"], "seq", "text").select("stream", "seq", "text")


@query(
    "wn23_display_pick",
    f"""SELECT stream, batch, arg_max(confirmed, seq) AS confirmed,
      coalesce(arg_max(hypothesis, seq) FILTER (WHERE action <> 'flush'), arg_max(hypothesis, seq)) AS draft
    FROM (SELECT *, seq // 4 AS batch FROM {TEXT_STATE}) GROUP BY stream, batch""",
)
def _(spark, sf):
    d = texts(spark, sf).withColumn("batch", F.floor(F.col("seq") / 4)).withColumn("is_flush", F.col("action") == "flush")
    return S.display_pick(d, ["stream", "batch"], "seq", "is_flush")
