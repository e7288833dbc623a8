"""Energy-based speech detection over frames, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.operators.ordered import Running, running
from utterlake.params import VadConfig


def speech_flags(df: DataFrame, keys: list[str], order: str, dbfs: Column, frame_ms: Column, config: VadConfig) -> DataFrame:
    """Speech per frame with hysteresis: on after enough loud time, off after enough quiet time.

    Loud and quiet spells are running sums that restart; the state is the latest switch. Needs the
    start level above the end level and both minimums positive; other settings need the stateful
    processor.
    """
    if not config.windowable:
        raise ValueError("start must lie above end and both minimums must be positive")
    d = running(
        df,
        keys,
        order,
        {
            "_hot": Running("run", frame_ms, reset=dbfs < config.start_dbfs),
            "_quiet": Running("run", frame_ms, reset=dbfs > config.end_dbfs),
        },
    )
    switch = F.when(F.col("_hot") >= config.min_speech_ms, True).when(
        F.col("_quiet") >= config.min_silence_ms, False
    )
    d = running(d, keys, order, {"speech": Running("last", switch)})
    return d.withColumn("speech", F.coalesce("speech", F.lit(False))).drop("_hot", "_quiet")


def speech_segments(df: DataFrame, keys: list[str], order: str, speech: str = "speech") -> DataFrame:
    """Onset and flush flags and the number of the speech segment a row belongs to or follows."""
    now = F.col(speech)
    none = F.lit(False)
    # the number of onsets is how often the flag has changed to true: one scan for both
    d = running(df, keys, order, {"_was": Running("prev", now, default=none), "segment": Running("changes", now, default=none, where=now)})
    return d.withColumn("onset", now & ~F.col("_was")).withColumn("flush", ~now & F.col("_was")).drop("_was")
