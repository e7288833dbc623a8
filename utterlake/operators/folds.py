"""Ordered folds per key as trees of mergeable partials.

A fold whose step is associative need not see a key's rows in one place. Each row is lifted to a partial; neighbours, ``fan`` at a
time by rank, are merged to one, and so on until a key has one partial. No list is longer than ``fan``, a hot key is spread over
its groups at each level, and the levels are as many as the logarithm of the longest key.

Rank is the place of a row in its key, from 0. A null partial counts as nothing. Keys without rows are not there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions import arrays as A
from utterlake.operators.ordered import ordinal
from utterlake.session import cut_lineage


def ordered_fold(
    df: DataFrame, keys: list[str], order: str, lift: Callable[[Column], Column], merge: Callable[[Column, Column], Column], name: str, fan: int = 64
) -> DataFrame:
    """(keys, name): the merged partials of each key's rows. ``lift`` takes the rank."""
    ranked = ordinal(df, keys, order, "_rank")
    d = ranked.select(*keys, (F.col("_rank") - 1).alias("_at"), lift(F.col("_rank") - 1).alias("_part"))
    d = cut_lineage(d, "partials")
    last = d.agg(F.max("_at")).first()[0] or 0
    while True:
        group = F.floor(F.col("_at") / fan).alias("_at")
        lists = d.where(F.col("_part").isNotNull()).groupBy(*keys, group).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_part").alias("part")))).alias("_l"))
        parts = F.col("_l.part")
        d = lists.select(*keys, "_at", F.aggregate(F.slice(parts, 2, fan), parts[0], merge).alias("_part"))
        last //= fan
        if not last:
            return d.select(*keys, F.col("_part").alias(name))
        d = cut_lineage(d, "partials")


@dataclass(frozen=True)
class Fold:
    """A fold whose partials merge: a row's partial, the merged partial of two neighbours, and the value of the last partial."""

    lift: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column]


def over_rows(df: DataFrame, keys: list[str], order: str, fold: Fold, value: Column, name: str) -> DataFrame:
    """(keys, name): the fold of the values of each key's rows."""
    d = ordered_fold(df, keys, order, lambda _: fold.lift(value), fold.merge, name)
    return d.withColumn(name, fold.finish(F.col(name)))


def over_lists(df: DataFrame, keys: list[str], order: str, folds: dict[str, tuple[Fold, Column, Callable[[Column], Column]]]) -> DataFrame:
    """(keys, one column per fold), where a row holds a list of consecutive items of its key and a function makes an item a value.

    A list is merged where it is, so that only partials move; all folds share the steps after that. An empty list counts as nothing.
    """

    def packed(f: Fold, items: Column, value: Callable[[Column], Column]) -> Column:
        start = f.lift(value(F.get(items, F.lit(0))))
        whole = F.aggregate(F.slice(items, 2, F.size(items)), start, lambda p, x: f.merge(p, f.lift(value(x))))
        return F.when(F.size(items) > 0, whole)

    def either(f: Fold, p: Column, q: Column) -> Column:
        return F.when(p.isNull(), q).when(q.isNull(), p).otherwise(f.merge(p, q))

    part = F.struct(*[packed(*f).alias(n) for n, f in folds.items()])
    merge = lambda p, q: F.struct(*[either(f[0], p[n], q[n]).alias(n) for n, f in folds.items()])
    d = ordered_fold(df, keys, order, lambda _: part, merge, "_all")
    return d.select(*keys, *[f[0].finish(F.col("_all")[n]).alias(n) for n, f in folds.items()])


def ewma(alpha: float) -> Fold:
    """Last exponential average: an affine step y -> a * y + b, and the value it has as the first step, where the first value starts it."""

    def lift(value: Column) -> Column:
        x = value.cast("double")
        return F.struct(x.alias("first"), F.lit(1 - alpha).alias("a"), (x * alpha).alias("b"))

    def merge(p: Column, q: Column) -> Column:
        return F.struct((q["a"] * p["first"] + q["b"]).alias("first"), (q["a"] * p["a"]).alias("a"), (q["a"] * p["b"] + q["b"]).alias("b"))

    return Fold(lift, merge, lambda p: p["first"])


def credit(steps: int, window: int) -> Fold:
    """Whole steps given out for frames, and the credit that is left, as a struct. Credit adds up, so
    it is the same wherever it is cut: with a minimum of one step, what is out is the whole part of the sum."""

    def finish(total: Column) -> Column:
        out = F.floor(total + 1e-9)
        return F.struct(out.alias("steps"), F.greatest(F.lit(0.0), total - out).alias("pending"))

    return Fold(lambda frames: F.greatest(F.lit(0), frames) * float(steps) / window, lambda p, q: p + q, finish)


def confirm() -> Fold:
    """What all lists begin with."""
    return Fold(lambda words: words, lambda p, q: A.take_first(p, A.lcp_len(p, q)), lambda p: p)


def merged() -> Fold:
    """Concatenation of lists without what a list repeats of the end of those before, where the repeats are exact.

    A partial is (words, first and last list, number of lists). Two neighbours overlap by the longest end of the left one's last list
    that the right one's first list begins with. Only lists that stand side by side are compared, which makes the rule associative; the
    rule of ``append_with_overlap`` looks at the whole text before a list, depends on what was merged first, and has no such form.
    """

    def lift(chunk: Column) -> Column:
        return F.struct(chunk.alias("words"), chunk.alias("first"), chunk.alias("last"))

    def merge(p: Column, q: Column) -> Column:
        known = A.suffix_prefix_overlap(p["last"], q["first"], 256)
        return F.struct(F.concat(p["words"], A.drop_first(q["words"], known)).alias("words"), p["first"].alias("first"), q["last"].alias("last"))

    return Fold(lift, merge, lambda p: p["words"])


def ewma_fold(df: DataFrame, keys: list[str], order: str, value: Column, alpha: float, name: str) -> DataFrame:
    return over_rows(df, keys, order, ewma(alpha), value, name)


def credit_fold(df: DataFrame, keys: list[str], order: str, frames: Column, steps: int, window: int, name: str) -> DataFrame:
    return over_rows(df, keys, order, credit(steps, window), frames, name)


def confirm_fold(df: DataFrame, keys: list[str], order: str, words: Column, name: str) -> DataFrame:
    return over_rows(df, keys, order, confirm(), words, name)


def merge_fold(df: DataFrame, keys: list[str], order: str, chunk: Column, name: str) -> DataFrame:
    return over_rows(df, keys, order, merged(), chunk, name)
