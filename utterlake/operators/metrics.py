"""Scoring: word error rate, overlap, duplication, percentiles, profiles, placement."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterlake.functions import arrays as A
from utterlake.operators import matching

#: Characters beyond the 16-bit plane, and how many of them words are hashed to.
FIRST_CODE = 0x10000
CODES = 0x100000
#: How many words of a pair can be numbered by such characters.
NUMBERS = 0x100000
#: Lists longer than this are compared within bands first, each eight times as wide as the one before.
BANDS_FROM = 128
#: Pairs with more words than this leave the character distance where words would have to be numbered.
LONG = 4096


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over words; null if a side is null.

    Each word becomes the character of its hash, and the built-in character distance does the rest. Long pairs try narrow
    bands first, so that their cost follows the distance. A pair in which two different words share a character numbers its
    words instead, which holds for NUMBERS distinct words and costs a search per word; ``edit_distances`` has no such limit.
    """

    def body(p: Column) -> Column:
        many = F.raise_error(F.lit(f"over {NUMBERS} distinct words in a pair; use edit_distances")).cast("int")
        by_number = _distance(p["a"], p["b"], lambda w: F.array_position(p["v"], w) - 1)
        numbered = F.when(F.size(p["v"]) > NUMBERS, many).otherwise(by_number)
        return F.when(_clash(p["v"]), numbered).otherwise(_distance(p["a"], p["b"], _code))

    pair = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("v"))
    return F.when(a == b, 0).otherwise(A.let(pair, body)).cast("bigint")


def edit_distances(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the distance of two word lists, whatever their length and number of distinct words.

    Long pairs whose words clash are compared in Arrow batches, by rows of a band; all others by ``edit_distance``.
    """
    words = F.array_distinct(F.concat(a, b))
    hard = F.coalesce((F.size(a) + F.size(b) > LONG) & _clash(words), F.lit(False))
    easy = df.where(~hard).withColumn(name, edit_distance(F.col(a), F.col(b)))
    return easy.unionByName(df.where(hard).withColumn(name, _numbered_distance(F.col(a), F.col(b))))


def _clash(words: Column) -> Column:
    """Whether two of the distinct words share a hash."""
    return F.size(F.array_distinct(F.transform(words, _code))) < F.size(words)


def _distance(a: Column, b: Column, code: Callable[[Column], Column]) -> Column:
    """Distance of two lists by the characters of their words."""
    text = lambda w: F.decode(F.unhex(F.array_join(F.transform(w, lambda x: F.lpad(F.hex(code(x) + FIRST_CODE), 8, "0")), "")), "UTF-32")
    return A.let(F.struct(text(a).alias("a"), text(b).alias("b")), lambda t: _banded(t["a"], t["b"]))


def _code(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(CODES))


def _banded(a: Column, b: Column) -> Column:
    """Character distance by the first band that holds it."""
    found = [F.nullif(F.levenshtein(a, b, limit), F.lit(-1)) for limit in (8, 64, 512, 4096)]
    full = F.levenshtein(a, b)
    return F.when(F.greatest(F.length(a), F.length(b)) > BANDS_FROM, F.coalesce(*found, full)).otherwise(full)


def list_distance(a: list, b: list, band: int = 16) -> int:
    """Levenshtein distance of two lists: what they share at both ends is cut off, then rows of a band are filled, and
    the band is made four times as wide until the distance fits in it."""
    code: dict = {}
    x, y = (np.fromiter((code.setdefault(w, len(code)) for w in side), np.int64, len(side)) for side in (a, b))
    for flip in (1, -1):
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[::flip][:n] != y[::flip][:n])
        same = int(differ[0]) if len(differ) else n
        x, y = x[::flip][same:][::flip], y[::flip][same:][::flip]
    n, m = len(x), len(y)
    if not n or not m:
        return n + m
    while True:
        half = max(min(band, max(n, m)), abs(n - m))
        shift = np.arange(-half, half + 1)
        far = n + m + 1
        padded = np.concatenate([np.full(half + 1, -1), y, np.full(half + n + 1, -1)])
        # row i holds the distances of x[:i] and y[: i + shift]; far marks what lies outside
        row = np.where((shift >= 0) & (shift <= m), shift, far)
        for i in range(1, n + 1):
            step = row + (padded[i : i + 2 * half + 1] != x[i - 1])
            step[:-1] = np.minimum(step[:-1], row[1:] + 1)
            j = i + shift
            step[(j < 0) | (j > m)] = far
            row = np.minimum.accumulate(step - shift) + shift
            row[(j < 0) | (j > m)] = far
        found = int(row[m - n + half])
        if found <= half or half >= max(n, m):
            return found
        band *= 4


@F.pandas_udf(T.LongType())
def _numbered_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else list_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows before work that is quadratic in a row's text; the shuffle costs far less."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sentence_wer(distance: Column, ref_words: Column, hyp_words: Column) -> Column:
    empty = F.when(hyp_words == 0, 0.0).otherwise(1.0)
    return F.when(ref_words == 0, empty).otherwise(distance / ref_words)


def sentence_wer_paired(distance: Column, ref_words: Column) -> Column:
    """The paired tool's variant: an empty reference scores 0."""
    return F.when(ref_words == 0, 0.0).otherwise(distance / ref_words)


def weighted_wer(wer: Column, ref_words: Column) -> Column:
    weight = F.greatest(ref_words, F.lit(1))
    return F.sum(wer * weight) / F.greatest(F.sum(weight), F.lit(1))


def total_edit_wer(distance: Column, ref_words: Column) -> Column:
    """Edits over reference words, on rows whose reference is not empty."""
    used = ref_words > 0
    return F.sum(F.when(used, distance)) / F.sum(F.when(used, ref_words))


def rtf(infer_total: Column, audio_total: Column) -> Column:
    """Inference over audio time; null where either total is missing or 0."""
    ok = (F.coalesce(infer_total, F.lit(0.0)) > 0) & (F.coalesce(audio_total, F.lit(0.0)) > 0)
    return F.when(ok, infer_total / audio_total)


def precision_recall(df: DataFrame) -> DataFrame:
    """Precision and recall from multiset_overlap totals, left being the reference."""
    r, h = F.col("left_words"), F.col("right_words")
    both = (r == 0) & (h == 0)
    precision = F.when(both | ((r > 0) & (h == 0)), 1.0).when(r == 0, 0.0).otherwise(F.col("overlap") / h)
    recall = F.when(r == 0, 1.0).when(h == 0, 0.0).otherwise(F.col("overlap") / r)
    return df.withColumn("precision", precision).withColumn("recall", recall)


def ngram_duplication(words: Column, n: int = 3) -> Column:
    """1 - distinct / total n-grams; 0 for fewer than n words."""
    def gram(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)])

    grams = F.transform(A.count_to(F.size(words) - n + 1), lambda i: gram(i - 1))
    return A.let(
        grams,
        lambda g: F.when(F.size(g) == 0, 0.0).otherwise(1.0 - F.size(F.array_distinct(g)) / F.size(g)),
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], accuracy: int = 50000
) -> DataFrame:
    """Exact linear-interpolated percentiles without gathering a group's values.

    A mergeable sketch brackets each percentile. One more pass counts values: those inside a bracket by
    value, those between brackets as one lump. The ranks are then read off the short list that is left.
    Groups small against the sketch need no bracket.
    """
    ks = keys or ["_all"]
    d = df.select(*(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_x"))
    d = d.where(F.col("_x").isNotNull())
    slack = 3.0 / accuracy
    points: list[float] = []
    for q in wanted.values():
        points += [max(0.0, q - slack), min(1.0, q + slack)]
    brackets = d.groupBy(*ks).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_x", F.array(*[F.lit(p) for p in points]), accuracy).alias("_b"),
    )
    if not keys:
        brackets = F.broadcast(brackets)  # one row
    j = d.join(brackets, ks)
    small = F.col("_n") <= 10 * accuracy
    inside = small
    gap = F.lit(0)
    for i in range(len(wanted)):
        low, high = F.col("_b")[2 * i], F.col("_b")[2 * i + 1]
        inside = inside | F.col("_x").between(low, high)
        gap = gap + F.when(F.col("_x") > high, 1).otherwise(0)
    counts = (
        j.groupBy(*ks, F.when(inside, F.col("_x")).alias("_v"), F.when(~inside, gap).alias("_g"))
        .agg(F.count("*").alias("_c"), F.min("_x").alias("_low"))
    )
    w = Window.partitionBy(*ks).orderBy("_low")
    ranked = counts.select(
        *ks,
        "_v",
        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"),
        "_c",
        F.sum("_c").over(Window.partitionBy(*ks)).alias("_n"),
    )
    aggs: list[Column] = []
    for name, q in wanted.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        before, upto = F.col("_to") - F.col("_c"), F.col("_to")

        def at(rank: Column, before: Column = before, upto: Column = upto) -> Column:
            return F.max(F.when((before <= rank) & (rank < upto), F.col("_v")))

        low, high = at(F.floor(pos)), at(F.ceil(pos))
        aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
    out = ranked.groupBy(*ks).agg(*aggs)
    return out if keys else out.drop("_all")


def approx_percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """Approximate percentiles in one pass, for dashboards."""
    cols = [F.percentile_approx(value, q, accuracy).alias(name) for name, q in wanted.items()]
    return df.groupBy(*keys).agg(*cols)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-block similarity of two strings, 2M / T."""
    return pd.Series([matching.ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same similarity over whitespace words."""
    return pd.Series(
        [
            difflib.SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio()
            for x, y in zip(a, b, strict=True)
        ]
    )


PROFILE_STAGES = ("feature", "prepare", "predict", "decode", "merge")
#: Counters that are given as totals.
PROFILE_COUNTS = (
    "encoder_windows", "encoder_reused", "encoder_computed", "reuse_steps", "compute_steps", "decoder_windows", "resumed_windows",
    "resumed_tokens", "predict_calls", "advance_calls", "emitted", "blanks",
)
PROFILE_FRAMES = ("requested_frames", "copied_frames")


def profile_rollup(df: DataFrame, keys: list[str], tail_from: Column | None = None) -> DataFrame:
    """Calls, averages per call, each stage's share of the total time, totals of all counters and their ratios.

    Columns: total_ms and <stage>_ms, PROFILE_COUNTS, PROFILE_FRAMES. ``tail_from`` restricts the sums to rows where it
    holds. A group without such rows has calls = 0 and nulls.
    """

    def total(name: str) -> Column:
        c = F.col(name) if tail_from is None else F.when(tail_from, F.col(name))
        return F.coalesce(F.sum(c), F.lit(0)).alias(name)

    sums = ["total_ms", *[f"{s}_ms" for s in PROFILE_STAGES], *PROFILE_COUNTS, *PROFILE_FRAMES]
    calls = F.count(F.lit(1) if tail_from is None else F.when(tail_from, F.lit(1)))
    d = df.groupBy(*keys).agg(calls.alias("calls"), *[total(c) for c in sums])

    def per(part: str | Column, whole: str | Column, least: float = 1.0) -> Column:
        part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
        return part / F.greatest(F.lit(least), whole)

    out = {f"avg_{c}": per(c, "calls") for c in sums if c.endswith("_ms") or c in PROFILE_FRAMES}
    out |= {f"share_{s}": per(f"{s}_ms", "total_ms", 1e-9) for s in PROFILE_STAGES}
    out |= {f"{c}_total": F.col(c) for c in PROFILE_COUNTS}
    out |= {
        "window_reuse_ratio": per("encoder_reused", "encoder_windows"),
        "step_reuse_ratio": per("reuse_steps", F.col("reuse_steps") + F.col("compute_steps")),
        "windows_per_call": per("decoder_windows", "calls"),
        "predicts_per_call": per("predict_calls", "calls"),
        "predicts_per_window": per("predict_calls", "decoder_windows"),
        "predicts_per_token": per("predict_calls", "emitted"),
        "advance_ratio": per("advance_calls", "predict_calls"),
    }
    return d.select(*keys, "calls", *[F.when(F.col("calls") > 0, c).alias(name) for name, c in out.items()])


def placement_rollup(df: DataFrame) -> DataFrame:
    """Counts and cost per device, per support list and per (op, device) in one pass, with the share of
    all cost and of work that only the CPU can run."""
    d = df.withColumn("signature", F.array_join("support", ","))
    g = d.groupingSets(
        [["device"], ["signature"], ["op", "device"]], "device", "signature", "op"
    ).agg(
        F.grouping("device").alias("gd"),
        F.grouping("signature").alias("gs"),
        F.grouping("op").alias("go"),
        F.count("*").alias("ops"),
        F.sum("cost").alias("cost"),
        F.count_if(F.col("support") == F.array(F.lit("CPU"))).alias("cpu_only"),
    )
    level = (
        F.when((F.col("gd") == 0) & (F.col("go") == 0), "op_device")
        .when(F.col("gd") == 0, "device")
        .otherwise("signature")
    )
    # A few rows per level: the groups are kinds of operations and devices.
    total = F.sum("cost").over(Window.partitionBy("level"))
    return g.withColumn("level", level).select(
        "level", "op", "device", "signature", "ops", "cpu_only", "cost",
        F.when(total > 0, F.col("cost") / total).otherwise(0.0).alias("share"),
    )


def budget_pick(df: DataFrame, keys: list[str], name: str, size: str, score: str, shares: dict[str, float]) -> DataFrame:
    """Two-tier pick by score: take while the total before the row is under the tier's share of all
    elements; the second tier skips what the first took."""
    from utterlake.operators.ordered import Running, ordinal, running

    (first, first_share), (second, second_share) = shares.items()
    order = ranked_order(df, keys, score, name)
    totals = df.groupBy(*keys).agg(F.sum(size).alias("_all"))
    d = order.join(totals, keys) if keys else order.crossJoin(F.broadcast(totals))  # one row
    d = running(d, keys, "_rank", {"_run": Running("sum", F.col(size))})
    took = F.col("_run") - F.col(size) < F.floor(F.col("_all") * first_share)
    d = d.withColumn("_first", took)
    rest = F.when(~F.col("_first"), F.col(size)).otherwise(0)
    d = running(d, keys, "_rank", {"_run2": Running("sum", rest)})
    took2 = ~F.col("_first") & (F.col("_run2") - F.col(size) < F.floor(F.col("_all") * second_share))
    tier = F.when(F.col("_first"), first).when(took2, second).otherwise("low")
    return d.withColumn("tier", tier).drop("_rank", "_all", "_run", "_run2", "_first")


def ranked_order(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """Dense rank column by score descending, name ascending, per key."""
    from utterlake.operators.joins import range_rank

    return range_rank(df, keys, [F.desc(score), F.asc(name)], "_rank")




def grouped_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Outlier, range and spread score per group of absolute values."""
    eps = 1e-8
    p = exact_percentiles(df, keys, value, {"_q95": 0.95, "_q99": 0.99, "_q999": 0.999})
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.max(value).alias("_max"),
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_std"),
    )
    return g.join(p, keys).select(
        *keys,
        "n",
        (F.col("_q999") / (F.col("_q99") + eps)).alias("outlier"),
        (F.col("_max") / (F.col("_q95") + eps)).alias("range_score"),
        (F.col("_std") / (F.col("_mean") + eps)).alias("std_score"),
    )
