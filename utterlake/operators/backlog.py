"""Catch-up, onset and shedding rules for queued chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.operators.ordered import ordinal


def catch_up_count(queued: Column, base: Column, target: Column, context: Column) -> Column:
    return F.when(queued <= 0, 0).otherwise(F.least(queued, F.greatest(base, target, context)))


def use_latest_first(enabled: bool, protect: Column, queued_samples: Column, trigger_samples: int) -> Column:
    return F.lit(enabled and trigger_samples > 0) & ~protect & (queued_samples > trigger_samples)


def onset_protect(
    elapsed: Column, words: Column, baseline_words: Column, min_words: int, max_onset_sec: float
) -> Column:
    """True while a new utterance has too few confirmed words and the onset window is still open."""
    in_window = F.lit(max_onset_sec > 0) & (elapsed >= 0) & (elapsed <= max_onset_sec)
    advance = F.greatest(F.lit(0), words - baseline_words)
    return F.coalesce(in_window, F.lit(False)) & (baseline_words == 0) & (advance < max(1, min_words))


def required_increment(
    stable: Column, onset_stride: int, onset_max: int, onset_words: int, words: Column, buffered: Column
) -> Column:
    """New samples needed before the next decode: the onset stride early on, the stable one later."""
    floor = F.greatest(F.lit(1), stable)
    early = (F.lit(onset_max > 0) & (buffered <= onset_max)) | (F.lit(onset_words > 0) & (words < onset_words))
    return F.when(early, F.least(floor, F.lit(max(1, onset_stride)))).otherwise(floor)


def resume_gate(words: Column, buffered: Column, onset_max: int, min_words: int) -> Column:
    if onset_max <= 0 and min_words <= 0:
        return F.lit(True)
    return (F.lit(min_words > 0) & (words >= min_words)) | (F.lit(onset_max > 0) & (buffered > onset_max))


def skip_warm_up(df: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    return ordinal(df, keys, order, "_nth").where(F.col("_nth") > count).drop("_nth")


def shed_counts(queued: Column, protect: Column, soft: Column, target: Column, context: Column, latest_first: bool) -> Column:
    """How many of the queued chunks survive the budget; all of them while nothing must go."""
    aim = F.greatest(F.lit(1), target, context if latest_first else F.lit(1))
    return F.when(~protect & (queued > soft) & (queued > 1) & (queued > aim), aim).otherwise(queued)


def shed(
    chunks: DataFrame,
    keys: list[str],
    order: str,
    soft: int,
    target: int,
    context: int,
    latest_first: bool = True,
    hard: int | None = None,
    protect: str | None = None,
) -> DataFrame:
    """Drop stale chunks per key: a ``kept`` flag per chunk and ``resync`` where the key lost some.

    The hard cap drops the oldest first. Then, over the soft budget, the newest (or, without
    latest_first, the oldest) chunks up to the target stay. Counting pre-aggregates; ranks use
    bounded blocks.
    """
    guard = F.coalesce(F.max(protect), F.lit(False)) if protect else F.lit(False)
    totals = chunks.groupBy(*keys).agg(F.count("*").alias("_all"), guard.alias("_protect"))
    capped = F.least(F.col("_all"), F.lit(hard)) if hard is not None else F.col("_all")
    totals = totals.withColumn("_queued", capped)
    kept = shed_counts(
        F.col("_queued"), F.col("_protect"), F.lit(soft), F.lit(target), F.lit(context), latest_first
    )
    totals = totals.withColumn("_keep", kept)
    d = ordinal(chunks, keys, order, "_nth").join(totals, keys)
    nth = F.col("_nth") - (F.col("_all") - F.col("_queued"))
    alive = (
        nth > F.col("_queued") - F.col("_keep") if latest_first else (nth >= 1) & (nth <= F.col("_keep"))
    )
    return d.select(*chunks.columns, alive.alias("kept"), (F.col("_keep") < F.col("_all")).alias("resync"))
