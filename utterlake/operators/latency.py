"""Latency of transcript events against audio ingress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions import text as X
from utterlake.functions import arrays as A
from utterlake.operators import metrics as M
from utterlake.operators.joins import asof_forward
from utterlake.operators.ordered import Running, recent, running
from utterlake.session import cut_lineage
from utterlake.operators.stabilize import with_previous


def elapsed_ms(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0.0), (later - earlier) * 1000)


def with_ingress(events: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Add ingress_at: when the audio up to an event's cursor had come in."""
    d = asof_forward(events, marks, keys, "cursor", "cursor", "received_at")
    return d.withColumnRenamed("received_at", "ingress_at")


def mark_of(text: Column) -> Column:
    """What tells a text from another where nothing else is asked of it: hash and length."""
    return F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("n"))


def steps(events: DataFrame, marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Events with ingress time and the speech flag and text marks of the event before.

    Only changes of texts matter here, so confirmed, hypothesis and merged become marks; any_text tells whether there is one.
    """
    texts = ("confirmed", "hypothesis", "merged")
    d = events.withColumn("any_text", X.strip_all(F.col("merged")) != "").withColumns({c: mark_of(F.col(c)) for c in texts})
    # Both sides of the lookup and the scans read this; the texts themselves end here and are worked out once.
    d = with_ingress(cut_lineage(d, "marked"), marks, keys)
    d = d.withColumn("flush_seq", F.when(F.col("is_flush"), F.col(order)))
    none = mark_of(F.lit(""))
    d = with_previous(
        d,
        keys,
        order,
        {
            "is_speech": F.lit(False),
            **dict.fromkeys(texts, none),
            "flush_seq": F.lit(None).cast(d.schema[order].dataType),
        },
    )
    # Several series and scans read this; written once, it is not worked out again for each.
    return cut_lineage(d, "steps")


def corrected() -> Column:
    """is_correction() for rows of steps()."""
    return (
        (F.col("confirmed") == F.col("prev_confirmed"))
        & (F.col("hypothesis") != F.col("prev_hypothesis"))
        & (F.col("prev_hypothesis.n") > 0)
    )


def draft_ready(stepped: DataFrame) -> DataFrame:
    """Latency of every change of the draft text."""
    d = stepped.where((F.col("hypothesis") != F.col("prev_hypothesis")) & F.col("ingress_at").isNotNull())
    return d.withColumn("ms", elapsed_ms(F.col("ready_at"), F.col("ingress_at")))


def onset() -> Column:
    return F.col("is_speech") & ~F.col("prev_is_speech")


def spoken(stepped: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Events of open speech segments with the segment's start and the text marks before it.

    A segment opens at the first speech event after silence and closes after its flush.
    """
    start = F.struct(
        F.col(order).alias("seq"),
        F.col("ingress_at").alias("ingress"),
        F.col("prev_confirmed").alias("confirmed"),
        F.col("prev_hypothesis").alias("hypothesis"),
        F.col("prev_merged").alias("merged"),
    )
    d = running(
        stepped,
        keys,
        order,
        {
            "start": Running("last", F.when(onset(), start)),
            "segment_no": Running("sum", onset().cast("bigint")),
            "flushed_before": Running("last", F.col("prev_flush_seq")),
        },
    )
    still_open = F.col("flushed_before").isNull() | (F.col("flushed_before") < F.col("start.seq"))
    return d.where(F.col("start").isNotNull() & still_open)


def segment_latencies(stepped: DataFrame, marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per speech segment: first draft, first merged text, final confirmation and its ready time, each in milliseconds.

    A stream's last segment may never flush. If there is a text at the end, the end of the stream stands in for its final
    confirmation (pending_ms), and the arrival of the last audio for its own (pending_ready_ms).
    """

    def first(value: str, condition: Column) -> Column:
        return F.min_by(value, F.when(condition, F.col(order)))

    speech, flush = F.col("is_speech"), F.col("is_flush")
    known = flush & (F.col("confirmed") != F.col("prev_confirmed")) & F.col("ingress_at").isNotNull()
    d = spoken(stepped, keys, order).groupBy(*keys, "segment_no").agg(
        F.min("start.ingress").alias("begin"),
        first("ready_at", speech & (F.col("hypothesis") != F.col("start.hypothesis"))).alias("draft_at"),
        first("ready_at", speech & (F.col("merged") != F.col("start.merged"))).alias("merged_at"),
        first("ready_at", flush & (F.col("confirmed") != F.col("start.confirmed"))).alias("final_at"),
        F.min_by(F.struct("ready_at", "ingress_at"), F.when(known, F.col(order))).alias("known"),
        F.max("ready_at").alias("last_at"),
        F.bool_or(flush).alias("flushed"),
        F.max_by("any_text", order).alias("any_text"),
    )
    ends = stepped.groupBy(*keys).agg(F.count_if(onset()).alias("_segments"))
    arrived = marks.groupBy(*keys).agg(F.max_by("received_at", "cursor").alias("_arrived"))
    d = d.join(ends, keys).join(arrived, keys, "left")
    pending = ~F.col("flushed") & F.col("any_text") & (F.col("segment_no") == F.col("_segments")) & F.col("begin").isNotNull()
    return d.select(
        *keys,
        "segment_no",
        elapsed_ms(F.col("draft_at"), F.col("begin")).alias("draft_ms"),
        elapsed_ms(F.col("merged_at"), F.col("begin")).alias("merged_ms"),
        elapsed_ms(F.col("final_at"), F.col("begin")).alias("final_ms"),
        elapsed_ms(F.col("known.ready_at"), F.col("known.ingress_at")).alias("ready_ms"),
        F.when(pending, elapsed_ms(F.col("last_at"), F.col("begin"))).alias("pending_ms"),
        F.when(pending, elapsed_ms(F.col("last_at"), F.col("_arrived"))).alias("pending_ready_ms"),
        "draft_at",
        "merged_at",
        "final_at",
        "known",
        "_arrived",
    )


def series(stepped: DataFrame, marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All latency series of ``steps`` as (series, ms)."""
    segments = segment_latencies(stepped, marks, keys, order)

    def one(name: str, ms: str, seen: str | None = None) -> Column:
        value = F.col(ms) if seen is None else F.when(F.col(seen).isNotNull(), F.col(ms))
        return F.struct(F.lit(name).alias("series"), value.alias("ms"))

    named = F.array(
        one("draft_first_token", "draft_ms", "draft_at"),
        one("merged_first_token", "merged_ms", "merged_at"),
        one("final_confirmed", "final_ms", "final_at"),
        one("final_confirmed", "pending_ms"),
        one("final_ready", "ready_ms", "known"),
        F.struct(F.lit("final_ready").alias("series"), F.when(F.col("pending_ms").isNotNull() & F.col("_arrived").isNotNull(), F.col("pending_ready_ms")).alias("ms")),
    )
    ready = draft_ready(stepped).select(F.lit("draft_ready").alias("series"), "ms")
    return segments.select(F.inline(named)).where(F.col("ms").isNotNull()).unionByName(ready)


def series_summary(latencies: DataFrame) -> DataFrame:
    """Average and exact p95 per series."""
    p95 = M.exact_percentiles(latencies, ["series"], "ms", {"p95": 0.95})
    return latencies.groupBy("series").agg(F.avg("ms").alias("avg"), F.count("*").alias("n")).join(p95, "series")


def realtime_summary(latencies: DataFrame, totals: DataFrame) -> DataFrame:
    """One summary row. ``totals`` is one row with audio_sec, infer_sec, wall_sec, corrections, max_queue_sec, processed and
    dropped. The first-token series is the draft one, or the merged one where no draft was seen."""
    s = series_summary(latencies)

    def pick(name: str, column: str) -> Column:
        return F.max(F.when(F.col("series") == name, F.col(column)))

    cols = []
    for name in ("draft_first_token", "merged_first_token", "final_confirmed", "draft_ready", "final_ready"):
        cols += [pick(name, "avg").alias(f"{name}_avg"), pick(name, "p95").alias(f"{name}_p95")]
    wide = s.agg(*cols)
    wide = wide.withColumn("first_token_avg", F.coalesce("draft_first_token_avg", "merged_first_token_avg"))
    wide = wide.withColumn("first_token_p95", F.coalesce("draft_first_token_p95", "merged_first_token_p95"))
    d = wide.crossJoin(F.broadcast(totals))  # one row each
    per_min = F.when(F.col("audio_sec") > 0, F.col("corrections") / F.col("audio_sec") * 60).otherwise(0.0)
    rtfx = F.col("audio_sec") / F.greatest(F.col("infer_sec"), F.lit(1e-9))
    wall = F.col("audio_sec") / F.greatest(F.col("wall_sec"), F.lit(1e-9))
    return d.withColumn("corrections_per_min", per_min).withColumn("infer_rtfx", rtfx).withColumn("wall_rtfx", wall)


def correction_count(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """How often a draft changed while the confirmed text stood still. Texts are told apart by their marks."""
    texts = ("confirmed", "hypothesis")
    d = cut_lineage(df.select(*keys, order, *[mark_of(F.col(c)).alias(c) for c in texts]), "marked")
    d = with_previous(d, keys, order, dict.fromkeys(texts, mark_of(F.lit(""))))
    return d.groupBy(*keys).agg(F.count_if(corrected()).alias("corrections"))


def rolling_stats(df: DataFrame, keys: list[str], order: str, value: Column, size: int = 256) -> DataFrame:
    """Current value, mean and p95 of the last ``size`` values."""
    d = recent(df, keys, order, value.cast("double"), "_last", size)
    last = F.col("_last")
    return d.select(
        *df.columns,
        F.get(last, F.size(last) - 1).alias("current"),
        A.mean_of(last).alias("mean"),
        A.percentile_of(last, 0.95).alias("p95"),
    )


def running_rtfx(df: DataFrame, keys: list[str], order: str, audio: Column, infer: Column) -> DataFrame:
    """Audio over inference time, both summed up to the row."""
    d = running(df, keys, order, {"_a": Running("sum", audio), "_i": Running("sum", infer)})
    return d.withColumn("rtfx", F.col("_a") / F.greatest(F.col("_i"), F.lit(1e-9))).drop("_a", "_i")


def latency_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and p95 per stage."""
    return M.exact_percentiles(df, keys, value, {"median": 0.5, "p95": 0.95})
