"""Scalar and filter queries over text and run columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.functions import text as X
from utterlake.operators import backlog as B
from utterlake.plans import fixtures as fx
from utterlake.plans.fixture_sql import norm_sql, strip_sql, words_sql
from utterlake.plans.registry import query


@query("pj1_normalize_basic", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", X.normalize_basic(F.col("text")).alias("norm"))


@query(
    "pj2_normalize_compare",
    "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g')) AS norm FROM documents",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", X.normalize_compare(F.col("text")).alias("norm"))


SPACED_SQL = "replace(replace(text, ', ', '\u00a0\t'), '. ', '\u3000')"


def spaced(text):
    """Planted no-break, tab and ideographic spaces."""
    return F.replace(F.replace(text, F.lit(", "), F.lit("\u00a0\t")), F.lit(". "), F.lit("\u3000"))


@query(
    "pj3_normalize_mode",
    f"""SELECT doc_id, {strip_sql("chr(160) || text || chr(10)")} AS as_none, {norm_sql('text')} AS as_basic, {norm_sql('text')} AS as_open_asr
    FROM documents""",
)
def _(spark, sf):
    texts = {"none": F.concat(F.lit("\u00a0"), "text", F.lit("\n")), "basic": F.col("text"), "open_asr": F.col("text")}
    modes = [X.normalize_mode(t, m).alias(f"as_{m}") for m, t in texts.items()]
    return fx.table(spark, sf, "documents").select("doc_id", *modes)


@query(
    "pj4_tokenize_ws",
    f"""SELECT conv_id, turn, array_to_string(w, '|') AS words
    FROM (SELECT conv_id, turn, {words_sql(SPACED_SQL)} AS w FROM conversations)""",
)
def _(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(X.tokenize(spaced(F.col("text"))), "|").alias("words")
    )


@query("pj5_word_count", f"SELECT conv_id, turn, len({words_sql(SPACED_SQL)}) AS n FROM conversations")
def _(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", X.word_count(spaced(F.col("text"))).alias("n"))


@query(
    "pj6_edge_punct_norm",
    r"""SELECT conv_id, turn, array_to_string(list_transform(words, lambda w:
      lower(regexp_replace(regexp_replace(w, '^\p{P}+', ''), '\p{P}+$', ''))), ' ') AS words FROM v_conv""",
)
def _(spark, sf):
    return fx.conv(spark, sf).select(
        "conv_id", "turn", F.array_join(F.transform("words", X.edge_punct_norm), " ").alias("words")
    )


ALNUM_SQL = (
    r"list_filter(list_transform({}, lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')), lambda w: w <> '')"
)


@query(
    "pj7_alnum_norm",
    f"SELECT conv_id, turn, array_to_string({ALNUM_SQL.format('words')}, ' ') AS words FROM v_conv",
)
def _(spark, sf):
    return fx.conv(spark, sf).select(
        "conv_id", "turn", F.array_join(X.alnum_words(F.col("words")), " ").alias("words")
    )


@query(
    "pj8_merged_transcript",
    """SELECT stream, segment, seq, concat_ws(' ', nullif(c, ''), nullif(h, '')) AS merged
    FROM (SELECT stream, segment, seq, array_to_string(words[1:len(words) // 2], ' ') AS c,
                 array_to_string(words[len(words) // 2 + 1:], ' ') AS h FROM v_part)""",
)
def _(spark, sf):
    half = F.floor(F.size("words") / 2).cast("int")
    d = fx.part(spark, sf)
    c = F.array_join(F.slice("words", F.lit(1), half), " ")
    h = F.array_join(F.slice("words", half + 1, F.size("words")), " ")
    return d.select("stream", "segment", "seq", X.merged_transcript(c, h).alias("merged"))


@query(
    "pj9_safe_float",
    """SELECT run_name, try_cast(CASE WHEN broken THEN 'n/a' ELSE CAST(n AS VARCHAR) || '.5' END AS DOUBLE) AS value
    FROM v_man""",
)
def _(spark, sf):
    raw = F.when(F.col("broken"), "n/a").otherwise(F.concat(F.col("n").cast("string"), F.lit(".5")))
    return fx.man(spark, sf).select("run_name", X.safe_float(raw).alias("value"))


@query("pj10_text_fingerprint", "SELECT doc_id, sha1(text) AS fingerprint FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", X.text_fingerprint(F.col("text")).alias("fingerprint")
    )


@query(
    "pj11_stride_id",
    r"""SELECT stride, repetition, s AS stride_text, 'stride_' || replace(s, '.', 'p') AS stride_id
    FROM (SELECT stride, repetition, regexp_replace(regexp_replace(printf('%.3f', stride), '0+$', ''), '\.$', '') AS s
          FROM v_sweep)""",
)
def _(spark, sf):
    return fx.sweep(spark, sf).select(
        "stride",
        "repetition",
        X.stride_text(F.col("stride")).alias("stride_text"),
        X.stride_id(F.col("stride")).alias("stride_id"),
    )


@query("pj12_pick_text", "SELECT id, text AS picked FROM v_ref")
def _(spark, sf):
    # The list column named first in the candidates wins over the plain one.
    d = fx.ref(spark, sf).select("id", F.col("text").alias("reference"))
    d = d.withColumn("sentence", F.split("reference", " "))
    return d.select("id", X.pick_text(d).alias("picked"))


@query("pj13_preview", "SELECT doc_id, translate(left(text, 120), chr(10), ' ') AS preview FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", X.preview(F.col("text"), 120).alias("preview"))


@query(
    "pj14_real_time_factor",
    """SELECT id, round(infer_a / greatest(audio_sec, 1e-9), 6) AS rtf, round(audio_sec / greatest(infer_a, 1e-9), 6) AS rtfx
    FROM v_hyp""",
)
def _(spark, sf):
    i, a = F.col("infer_a"), F.col("audio_sec")
    return fx.hyp(spark, sf).select(
        "id",
        F.round(X.real_time_factor(i, a), 6).alias("rtf"),
        F.round(X.speed_factor(i, a), 6).alias("rtfx"),
    )


@query(
    "pj17_catch_up_count",
    """SELECT stream, hour, CASE WHEN queued <= 0 THEN 0 ELSE least(queued, greatest(1, 2, words)) END AS take
    FROM v_back""",
)
def _(spark, sf):
    take = B.catch_up_count(F.col("queued"), F.lit(1), F.lit(2), F.col("words"))
    return fx.back(spark, sf).select("stream", "hour", take.cast("bigint").alias("take"))


@query(
    "pj18_catch_up_gate",
    """SELECT stream, hour, protect, NOT protect AND queued * 5120 > 8000 AS latest_first FROM (
      SELECT *, elapsed >= 0 AND elapsed <= 0.8 AND words < 2 AS protect FROM v_back)""",
)
def _(spark, sf):
    protect = B.onset_protect(F.col("elapsed"), F.col("words"), F.lit(0), 2, 0.8)
    d = fx.back(spark, sf).withColumn("protect", protect)
    gate = B.use_latest_first(True, F.col("protect"), F.col("queued") * 5120, 8000)
    return d.select("stream", "hour", "protect", gate.alias("latest_first"))


@query(
    "pj19_required_increment",
    """SELECT stream, hour, CASE WHEN queued * 5120 <= 12800 OR words < 2 THEN least(12000, 4000) ELSE 12000 END AS required
    FROM v_back""",
)
def _(spark, sf):
    need = B.required_increment(F.lit(12000), 4000, 12800, 2, F.col("words"), F.col("queued") * 5120)
    return fx.back(spark, sf).select("stream", "hour", need.alias("required"))


@query(
    "pj20_resume_gate",
    "SELECT stream, hour, words >= 2 OR queued * 5120 > 12800 AS resume FROM v_back",
)
def _(spark, sf):
    gate = B.resume_gate(F.col("words"), F.col("queued") * 5120, 12800, 2)
    return fx.back(spark, sf).select("stream", "hour", gate.alias("resume"))


@query(
    "ar31_tail_frame_count",
    "SELECT stream, hour, least(24, greatest(8, 12, queued * 4)) AS frames FROM v_back",
)
def _(spark, sf):
    from utterlake.functions.arrays import tail_frame_count

    frames = tail_frame_count(F.lit(24), F.col("queued"), 12, 4, 8)
    return fx.back(spark, sf).select("stream", "hour", frames.alias("frames"))


@query(
    "fl1_non_empty_reference",
    """SELECT count(*) FILTER (WHERE trim(text) <> '') AS scored, count(*) FILTER (WHERE trim(text) = '') AS skipped
    FROM v_ref""",
)
def _(spark, sf):
    used = F.trim("text") != ""
    return fx.ref(spark, sf).agg(F.count_if(used).alias("scored"), F.count_if(~used).alias("skipped"))


@query(
    "fl2_warm_up_skip",
    """SELECT stream, count(*) AS n, round(sum(ready_at - received_at), 3) AS lag_sec
    FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS rn FROM v_ev) WHERE rn > 3 GROUP BY stream""",
)
def _(spark, sf):
    d = B.skip_warm_up(fx.ingress(spark, sf), ["stream"], "seq", 3)
    return d.groupBy("stream").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("ready_at") - F.col("received_at")), 3).alias("lag_sec")
    )


@query(
    "fl3_status_filter",
    """SELECT dataset, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed
    FROM v_man GROUP BY dataset""",
)
def _(spark, sf):
    ok = F.col("status") == "ok"
    return fx.man(spark, sf).groupBy("dataset").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
