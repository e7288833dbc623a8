"""Recurrences over ordered rows: exponential averages and step credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.operators.ordered import Running, running
from utterlake.params import AdaptiveStride

FAN = 1024


def affine_before(df: DataFrame, keys: list[str], order: str, a: str, b: str, levels: int = 3) -> DataFrame:
    """The value of y = a * y + b before each row, y starting at 0.

    Such steps compose, so blocks of at most FAN rows are composed first and the same scan over the
    blocks gives each block its start. Three levels leave lists of at most FAN up to order FAN ** 4.
    """
    blk = f"_blk{levels}"
    d = df.withColumn(blk, F.floor(F.col(order) / FAN) if levels else F.lit(0).cast("bigint"))
    step = F.struct(F.col(order).alias("o"), F.col(a).alias("a"), F.col(b).alias("b"))
    g = d.groupBy(*keys, blk).agg(F.array_sort(F.collect_list(step)).alias("_s"))

    def compose(acc: Column, s: Column) -> Column:
        row = F.struct(s["o"].alias("o"), acc["a"].alias("a"), acc["b"].alias("b"))
        return F.struct(
            F.concat(acc["rows"], F.array(row)).alias("rows"),
            (s["a"] * acc["a"]).alias("a"),
            (s["a"] * acc["b"] + s["b"]).alias("b"),
        )

    start = F.struct(
        F.array().cast("array<struct<o:bigint,a:double,b:double>>").alias("rows"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")
    )
    g = g.select(*keys, blk, F.aggregate("_s", start, compose).alias("_c"))
    if levels:
        whole = g.select(*keys, blk, F.col("_c.a").alias("_a"), F.col("_c.b").alias("_b"))
        starts = affine_before(whole, keys, blk, "_a", "_b", levels - 1)
        g = g.join(starts.select(*keys, blk, F.col("before").alias("_y")), [*keys, blk])
    else:
        g = g.withColumn("_y", F.lit(0.0))
    before = g.select(*keys, "_y", F.inline("_c.rows"))
    before = before.select(*keys, F.col("o").alias(order), (F.col("a") * F.col("_y") + F.col("b")).alias("before"))
    return df.join(before, [*keys, order])


def ewma(df: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """Exponential average seeded by the first usable value; values that are not finite and positive
    change nothing. The average is 0 before any."""
    v = F.col(value)
    usable = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    first = df.where(usable).groupBy(*keys).agg(F.min(order).alias("_first"))
    d = df.join(first, keys, "left")
    seed = F.coalesce(F.col(order) == F.col("_first"), F.lit(False))
    d = d.withColumn("_a", F.when(~usable, 1.0).when(seed, 0.0).otherwise(1.0 - alpha))
    d = d.withColumn("_b", F.when(~usable, 0.0).when(seed, v).otherwise(v * alpha))
    d = affine_before(d, keys, order, "_a", "_b")
    return d.withColumn("ewma", F.col("_a") * F.col("before") + F.col("_b")).drop("_a", "_b", "_first", "before")


def adaptive_stride(average: Column, p: AdaptiveStride) -> Column:
    """Samples to wait for, from the average decode time."""
    need = F.ceil(average * p.sample_rate / p.utilization)
    low, high, base = (int(s * p.sample_rate) for s in (p.min_sec, p.max_sec, p.base_sec))
    return F.greatest(F.lit(base), F.least(F.lit(high), F.greatest(F.lit(low), need)))


def step_credit(df: DataFrame, keys: list[str], order: str, frames: str, steps: int, window: int, minimum: int = 1) -> DataFrame:
    """Whole encoder steps that fractional credit pays for.

    With a minimum of at most 1 the steps so far are the floor of the credit so far, a running sum.
    A larger minimum spends ahead and forgets, which only the CreditProcessor can follow.
    """
    if minimum > 1:
        raise ValueError("a minimum above 1 needs the stateful CreditProcessor")
    n = F.greatest(F.col(frames), F.lit(0)).cast("bigint")
    d = running(df, keys, order, {"_sum": Running("sum", n)})
    upto = F.floor(F.col("_sum") * steps / window + 1e-9)
    before = F.floor((F.col("_sum") - n) * steps / window + 1e-9)
    return d.withColumn("steps", (upto - before).cast("bigint")).drop("_sum")
