"""Window and segment plans over lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.arrays import let


def window_shape(encoder: int, left: int, right: int) -> tuple[int, int, int]:
    """Clamp contexts to the encoder length; gives (left, right, hop)."""
    room = max(0, encoder - 1)
    left = min(max(0, left), room)
    right = min(max(0, right), max(0, room - left))
    return left, right, max(1, encoder - left - right)


def window_keys(total: Column, encoder: int, left: int, right: int) -> Column:
    """All windows of a length as structs, in order."""
    left, _, hop = window_shape(encoder, left, right)

    def key(start: Column) -> Column:
        begin = F.greatest(F.lit(0), start - left)
        return F.struct(
            start.alias("center_start"),
            begin.alias("input_start"),
            F.least(F.lit(encoder), total - begin).alias("actual_frames"),
            F.least(F.lit(hop), total - start).alias("center_frames"),
        )

    return F.transform(starts(total, hop), key)


def starts(total: Column, hop: int) -> Column:
    """0, hop, 2 hop, ... below ``total``; empty for total < 1."""
    none = F.array().cast("array<bigint>")
    return F.when(total < 1, none).otherwise(
        F.sequence(F.lit(0).cast("bigint"), total.cast("bigint") - 1, F.lit(hop).cast("bigint"))
    )


def window_plan(df: DataFrame, total: str, encoder: int, left: int, right: int) -> DataFrame:
    """One row per window of each length."""
    return df.select("*", F.inline(window_keys(F.col(total), encoder, left, right)))


def window_project(
    steps: Column, input_start: Column, center_start: Column, actual: Column, center: Column, hop: int
) -> Column:
    """The encoder steps that belong to a window's centre; a short last window takes the whole tail."""

    def body(p: Column) -> Column:
        scale = p["steps"] / p["actual"]
        low = F.greatest(F.lit(0), F.least(F.round((p["center_start"] - p["input_start"]) * scale), p["steps"]))
        width = F.greatest(F.lit(1), F.round(p["center"] * scale))
        high = F.when(p["center"] < hop, p["steps"]).otherwise(
            F.greatest(low, F.least(p["steps"].cast("double"), low + width))
        )
        none = (p["steps"] <= 0) | (p["actual"] <= 0)
        return F.struct(
            F.when(none, 0).otherwise(low).cast("bigint").alias("step_start"),
            F.when(none, 0).otherwise(F.greatest(F.lit(0.0), high - low)).cast("bigint").alias("step_count"),
        )

    return let(
        F.struct(
            steps.cast("bigint").alias("steps"),
            input_start.alias("input_start"),
            center_start.alias("center_start"),
            actual.alias("actual"),
            center.alias("center"),
        ),
        body,
    )


def segment_step(segment: int, overlap: int) -> tuple[int, int]:
    """(overlap, step); an overlap as long as the segment becomes a quarter of it."""
    if overlap >= segment:
        overlap = segment // 4
    return overlap, max(1, segment - overlap)


def segment_plan(df: DataFrame, total: str, segment: int, overlap: int) -> DataFrame:
    """One row per segment; the first segment that reaches the end is the last."""
    overlap, step = segment_step(segment, overlap)
    n = F.col(total)
    d = df.select("*", F.explode(starts(n, step)).alias("seg_start"))
    d = d.where((F.col("seg_start") == 0) | (F.col("seg_start") - step + segment < n))
    return d.withColumn("seg_end", F.least(F.col("seg_start") + segment, n))
