"""Sweep candidates, run manifests and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.functions import text as X

# What a run's status becomes when its summary file is absent or broken.
MISSING, INVALID = "missing_summary", "invalid_summary"

SUMMARY_SCHEMA = (
    "global_metrics struct<wer:struct<global_result:string>>, rtf string, speed_x string, num_samples string, "
    "total_audio_sec string, total_prediction_sec string, _bad string"
)


def with_exact_match(runs: DataFrame, baseline: float) -> DataFrame:
    """Add each run's fingerprint, the baseline's first one and whether all baseline runs share it."""
    d = runs.withColumn("sha", F.sha1("text"))
    base = d.where(F.col("stride") == baseline).agg(
        F.min_by("sha", "repetition").alias("canonical"),
        (F.count_distinct("sha") == 1).alias("baseline_consistent"),
    )
    # The baseline is one row.
    return d.crossJoin(F.broadcast(base)).withColumn("exact_match", F.coalesce(F.col("sha") == F.col("canonical"), F.lit(False)))


def sweep_aggregate(
    runs: DataFrame, baseline: float, min_rtfx: float = 1.2, max_corrections: int = 0
) -> DataFrame:
    """One row per candidate stride: means, spreads, gates and ordered fail reasons."""
    d = with_exact_match(runs, baseline)

    def spread(name: str) -> Column:
        return F.stddev_pop(name)

    fixes = F.coalesce("corrections", F.lit(0))
    g = d.groupBy("stride").agg(
        F.count("*").alias("run_count"),
        F.bool_and("exact_match").alias("exact_match_all"),
        F.bool_and("baseline_consistent").alias("baseline_consistent"),
        F.avg("infer_rtfx").alias("infer_rtfx_mean"),
        F.min("infer_rtfx").alias("infer_rtfx_min"),
        F.max(fixes).alias("corrections_max"),
        F.sum(fixes).alias("corrections_total"),
        F.avg("primary_ms").alias("primary_mean"),
        spread("primary_ms").alias("primary_stdev"),
        F.avg("p95_ms").alias("p95_mean"),
    )
    low = F.col("infer_rtfx_min").isNull() | (F.col("infer_rtfx_min") < min_rtfx)
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("exact_match_all"), "confirmed transcript mismatch"),
            F.when(low, f"infer_rtfx < {min_rtfx}"),
            F.when(F.col("corrections_max") > max_corrections, f"corrections > {max_corrections}"),
            F.when(~F.col("baseline_consistent"), "baseline transcript unstable across repetitions"),
        )
    )
    return g.withColumn("fail_reasons", reasons).withColumn("pass", F.size("fail_reasons") == 0)


def recommend(candidates: DataFrame, epsilon_ms: float = 5.0) -> DataFrame:
    """Passing candidates as good as the fastest, best headroom first; the first one is recommended.

    Candidates are the strides of one sweep, a handful of rows after aggregation.
    """
    inf = F.lit(float("inf"))
    d = candidates.where("pass").select(
        "*",
        F.coalesce("primary_mean", inf).alias("_p"),
        F.coalesce("p95_mean", inf).alias("_q"),
        (-F.coalesce("infer_rtfx_min", F.lit(0.0))).alias("_h"),
    )
    best = d.agg(F.min_by("primary_mean", F.struct("_p", "_q", "_h", "stride")).alias("best"))
    d = d.crossJoin(F.broadcast(best))  # one row
    near = d.where(F.col("best").isNull() | (F.col("_p") <= F.col("best") + max(0.0, epsilon_ms)))
    by_latency = F.when(F.col("best").isNull(), F.col("_p"))
    w = Window.orderBy(by_latency, "_h", "_q", "_p", "stride")
    near = near.withColumn("rank", F.row_number().over(w))
    near = near.withColumn("cutoff", F.col("best") + max(0.0, epsilon_ms))
    return near.withColumn("recommended", F.col("rank") == 1).drop("_p", "_q", "_h", "best")


def with_baseline_first(candidates: DataFrame, baseline: float) -> DataFrame:
    """Candidate strides in the given order, once each, the baseline in front if it was missing."""
    head = candidates.sparkSession.range(1).select(F.lit(baseline).alias("stride"), F.lit(-1).cast("bigint").alias("ord"))
    listed = candidates.select("stride", F.col("ord").cast("bigint").alias("ord"))
    return head.unionByName(listed).groupBy("stride").agg(
        F.coalesce(F.min(F.when(F.col("ord") >= 0, F.col("ord"))), F.lit(-1)).alias("ord")
    )


def manifest_report(manifest: DataFrame, summaries: DataFrame) -> DataFrame:
    """Manifest rows with the metrics of their summary text; ok runs without a usable summary get a
    status of their own, others keep null metrics."""
    parsed = F.from_json("summary", SUMMARY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    s = summaries.select("run_name", "summary", parsed.alias("s"))
    d = manifest.join(s, "run_name", "left")
    ok = F.col("status") == "ok"
    missing = F.col("summary").isNull()
    bad = F.col("s").isNull() | F.col("s._bad").isNotNull()
    status = F.when(ok & missing, MISSING).when(ok & bad, INVALID).otherwise(F.col("status"))
    good = ok & ~missing & ~bad
    return d.select(
        "dataset",
        "profile",
        "run_name",
        status.alias("status"),
        # Numbers are read as text and cast one by one, so that a quoted or broken one spoils no other.
        F.when(good, X.safe_float(F.col("s.global_metrics.wer.global_result"))).alias("wer"),
        F.when(good, X.safe_float(F.col("s.rtf"))).alias("rtf"),
        F.when(good, X.safe_float(F.col("s.num_samples")).cast("bigint")).alias("num_samples"),
        *[F.when(good, X.safe_float(F.col(f"s.{c}"))).alias(c) for c in ("speed_x", "total_audio_sec", "total_prediction_sec")],
    )


def matrix_totals(report: DataFrame) -> DataFrame:
    """Total, ok and failed runs by dataset and profile with subtotals."""
    ok = F.col("status") == "ok"
    return report.rollup("dataset", "profile").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")
    )


def ranked_pick(names: DataFrame, keys: list[str], name: str, pattern: str) -> DataFrame:
    """The name to use per key: one with the pattern in it if any, then the shortest."""
    order = F.struct(~F.contains(F.col(name), F.lit(pattern)), F.length(name), F.col(name))
    return names.groupBy(*keys).agg(F.min_by(name, order).alias("picked"))


def keep_best(hyps: DataFrame, keys: list[str], identity: list[str], score: str, top: int) -> DataFrame:
    """Best score per identical hypothesis, then the ``top`` of each key. Both steps cut rows before
    the shuffle, so one key with most hypotheses stays cheap."""
    best = hyps.groupBy(*keys, *identity).agg(F.max(score).alias(score))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *identity)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def settings_text(recommended: DataFrame, epsilon_ms: float) -> DataFrame:
    """The recommended settings as key=value lines with comments."""
    fixed = lambda c: F.format_string("%.3f", F.col(c))
    line = F.concat_ws(
        "\n",
        F.lit(f"# latency_equivalence_ms={epsilon_ms}"),
        F.concat(
            F.lit("# recommended_stride="), fixed("stride"), F.lit(" primary_mean="), fixed("primary_mean"),
            F.lit(" primary_p95_mean="), fixed("p95_mean"), F.lit(" infer_rtfx_min="), fixed("infer_rtfx_min"),
        ),
        F.concat(F.lit("decode_stride_sec="), fixed("stride")),
    )
    found = recommended.where("recommended").select(line.alias("value"))
    # One row where nothing passes; the candidates of a sweep are a handful.
    none = F.lit(f"# latency_equivalence_ms={epsilon_ms}\n# no passing candidate found").alias("value")
    count = recommended.agg(F.count_if("recommended").alias("n"))
    return found.unionByName(count.where("n = 0").select(none))
