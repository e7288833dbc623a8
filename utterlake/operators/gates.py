"""Pass or fail rules on metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_gate(
    df: DataFrame,
    ratio: str,
    recall: str,
    duplication: str,
    min_ratio: float = 0.70,
    min_recall: float = 0.60,
    max_duplication: float = 0.25,
) -> DataFrame:
    """Missing ratio or recall counts 0, missing duplication 1."""
    ratio_ok = F.coalesce(F.col(ratio), F.lit(0.0)) >= min_ratio
    recall_ok = F.coalesce(F.col(recall), F.lit(0.0)) >= min_recall
    dup_ok = F.coalesce(F.col(duplication), F.lit(1.0)) <= max_duplication
    return (
        df.withColumn("ratio_ok", ratio_ok)
        .withColumn("recall_ok", recall_ok)
        .withColumn("dup_ok", dup_ok)
        .withColumn("pass", ratio_ok & recall_ok & dup_ok)
    )


def realtime_gates(
    max_queue_sec: Column,
    first_p95: Column,
    final_p95: Column,
    queue_limit: float = 0.5,
    first_limit: float = 300.0,
    final_limit: float = 1700.0,
) -> list[Column]:
    """Queue, first-token and final gates; an empty latency series fails. The overall pass needs the
    first two."""
    inf = F.lit(float("inf"))
    queue = max_queue_sec <= queue_limit
    first = F.coalesce(first_p95, inf) <= first_limit
    final = F.coalesce(final_p95, inf) <= final_limit
    return [
        queue.alias("pass_queue"),
        first.alias("pass_first_token"),
        final.alias("pass_final_confirmed"),
        (queue & first).alias("pass"),
    ]
