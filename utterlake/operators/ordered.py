"""Ordered computations per key that stay bounded when one key holds much of the data.

Rows of a key are cut into blocks of its integer order column. A block holds at most ``width`` rows,
as (keys, order) is unique, so a window over (keys, block) never sees an unbounded group. What crosses
block borders is one small summary row per block, scanned by a second window and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16
BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """A running value: kind is sum, max, min, last (skips nulls), prev (row before, nulls kept),
    run (sum since the last row where ``reset`` holds; that row counts 0) or changes (how many rows so far had another
    value than the row before; ``default`` stands before the first row, and only rows where ``where`` holds count)."""

    kind: str
    value: Column
    reset: Column | None = None
    default: Column | None = None
    where: Column | None = None


def with_block(df: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def running(
    df: DataFrame, keys: list[str], order: str, specs: dict[str, Running], width: int = WIDTH
) -> DataFrame:
    """Add one running column per entry of ``specs``, in ``order`` within ``keys``."""
    cols = df.columns
    part = [*keys, BLOCK]
    d = with_block(df, order, width)
    for name, s in specs.items():
        d = d.withColumn(f"_v_{name}", s.value)
        if s.kind == "run":
            d = d.withColumn(f"_r_{name}", F.coalesce(s.reset, F.lit(False)))
            d = d.withColumn(
                f"_v_{name}", F.when(F.col(f"_r_{name}"), F.lit(0)).otherwise(F.col(f"_v_{name}"))
            )
        elif s.kind == "changes":
            d = d.withColumn(f"_w_{name}", F.coalesce(s.where, F.lit(False)) if s.where is not None else F.lit(True))
    seq = Window.partitionBy(*part).orderBy(order)
    upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    inside: list[Column] = []
    totals: list[Column] = []
    for name, s in specs.items():
        v = F.col(f"_v_{name}")
        if s.kind in ("sum", "max", "min"):
            fn = getattr(F, s.kind)
            inside.append(fn(v).over(upto).alias(f"_i_{name}"))
            totals.append(fn(v).alias(f"_t_{name}"))
        elif s.kind == "last":
            inside.append(F.last(v, ignorenulls=True).over(upto).alias(f"_i_{name}"))
            totals.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"_t_{name}"))
        elif s.kind == "prev":
            inside.append(F.lag(F.struct(v.alias("v"))).over(seq).alias(f"_i_{name}"))
            totals.append(F.max_by(F.struct(v.alias("v")), F.col(order)).alias(f"_t_{name}"))
        elif s.kind == "run":
            inside.append(F.sum(v).over(upto).alias(f"_i_{name}"))
            totals.append(F.sum(v).alias(f"_t_{name}"))
        elif s.kind == "changes":
            # within a block; whether its first row is a change depends on the block before
            before_row = F.lag(F.struct(v.alias("v"))).over(seq)
            changed = before_row.isNotNull() & ~v.eqNullSafe(before_row["v"]) & F.col(f"_w_{name}")
            inside.append(changed.cast("bigint").alias(f"_e_{name}"))
        else:
            raise ValueError(s.kind)
    runs = [n for n, s in specs.items() if s.kind == "run"]
    changes = [n for n, s in specs.items() if s.kind == "changes"]
    rows = d.select("*", *inside)
    if changes:
        rows = rows.select("*", *[F.sum(f"_e_{n}").over(upto).alias(f"_i_{n}") for n in changes])
        edges = []
        for n in changes:
            edge = F.struct(F.col(f"_v_{n}").alias("v"), F.col(f"_w_{n}").alias("w"))
            edges.append(F.struct(F.sum(f"_e_{n}").alias("n"), F.min_by(edge, order).alias("first"), F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), order).alias("last")).alias(f"_t_{n}"))
    plain = [t for (_, s), t in zip(((n, s) for n, s in specs.items() if s.kind != "changes"), totals, strict=True) if s.kind != "run"]
    if runs:
        # Sum at the latest reset; the run is what came after it.
        rows = rows.select(
            "*",
            *[
                F.last(F.when(F.col(f"_r_{n}"), F.col(f"_i_{n}")), ignorenulls=True).over(upto).alias(f"_b_{n}")
                for n in runs
            ],
        )
        ends = rows.groupBy(*part).agg(
            *[F.max_by(F.struct(f"_i_{n}", f"_b_{n}"), F.col(order)).alias(f"_t_{n}") for n in runs]
        )
        if plain:
            ends = ends.join(d.groupBy(*part).agg(*plain), part)
    elif plain:
        ends = d.groupBy(*part).agg(*plain)
    if changes:
        own = rows.groupBy(*part).agg(*edges)
        ends = ends.join(own, part) if runs or plain else own

    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry: list[Column] = []
    for name, s in specs.items():
        t = F.col(f"_t_{name}")
        if s.kind in ("sum", "max", "min"):
            carry.append(getattr(F, s.kind)(t).over(before).alias(f"_c_{name}"))
        elif s.kind == "last":
            carry.append(F.last(t, ignorenulls=True).over(before).alias(f"_c_{name}"))
        elif s.kind == "prev":
            carry.append(F.lag(t).over(blocks).alias(f"_c_{name}"))
        elif s.kind == "changes":
            ends = ends.withColumn(f"_p_{name}", F.coalesce(F.lag(t["last"]).over(blocks), F.struct(s.default.alias("v"))))
            edge = (~t["first"]["v"].eqNullSafe(F.col(f"_p_{name}")["v"]) & t["first"]["w"]).cast("bigint")
            ends = ends.withColumn(f"_f_{name}", edge)
            sofar = F.coalesce(F.sum(t["n"] + F.col(f"_f_{name}")).over(before), F.lit(0))
            carry.append((sofar + F.col(f"_f_{name}")).alias(f"_c_{name}"))
        else:
            # Running total over blocks, and its value at the latest reset.
            ends = ends.withColumn(
                f"_g_{name}", F.sum(t[f"_i_{name}"]).over(blocks.rowsBetween(Window.unboundedPreceding, 0))
            )
            ends = ends.withColumn(
                f"_h_{name}",
                F.when(t[f"_b_{name}"].isNotNull(), F.col(f"_g_{name}") - t[f"_i_{name}"] + t[f"_b_{name}"]),
            )
            carry.append(
                (
                    F.lag(f"_g_{name}").over(blocks)
                    - F.coalesce(F.last(f"_h_{name}", ignorenulls=True).over(before), F.lit(0))
                ).alias(f"_c_{name}")
            )
    carried = ends.select(*part, *carry)

    out: list[Column] = []
    for name, s in specs.items():
        i, c = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if s.kind == "sum":
            value = F.when(c.isNull(), i).otherwise(F.coalesce(i, F.lit(0)) + c)
        elif s.kind == "max":
            value = F.greatest(i, c)
        elif s.kind == "min":
            value = F.least(i, c)
        elif s.kind == "last":
            value = F.coalesce(i, c)
        elif s.kind == "changes":
            value = i + c
        elif s.kind == "prev":
            found = F.coalesce(i, c)
            value = found["v"]
            if s.default is not None:
                value = F.when(found.isNull(), s.default).otherwise(value)
        else:
            b = F.col(f"_b_{name}")
            value = F.when(b.isNull(), i + F.coalesce(c, F.lit(0))).otherwise(i - b)
        out.append(value.alias(name))
    keep = [c for c in cols if c not in specs]
    return rows.join(carried, part, "left").select(*keep, *out)


def recent(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int, width: int | None = WIDTH
) -> DataFrame:
    """Add the list of the last ``size`` values, the row's own included.

    With ``width`` None the caller vouches that a key is bounded (a speech segment, which is flushed
    by force after a fixed number of chunks) and one plain window does.
    """
    cols = df.columns
    if width is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), 0)
        return df.select(*cols, F.collect_list(value).over(w).alias(name))
    part = [*keys, BLOCK]
    d = with_block(df, order, width).withColumn("_v", value)
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(-(size - 1), 0)
    rows = d.withColumn("_i", F.collect_list("_v").over(w))
    if size == 1:
        return rows.select(*cols, F.col("_i").alias(name))
    tails = rows.groupBy(*part).agg(F.max_by("_i", order).alias("_t"))
    # Every block has a row, so the last values lie within the size - 1 blocks before.
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-(size - 1), -1)
    carried = tails.select(*part, F.flatten(F.collect_list("_t").over(before)).alias("_c"))

    def last(items: Column) -> Column:
        return F.slice(items, F.greatest(F.size(items) - size + 1, F.lit(1)), F.lit(size))

    full = F.when((F.size("_i") >= size) | F.col("_c").isNull(), F.col("_i")).otherwise(
        last(F.concat("_c", "_i"))
    )
    return rows.join(carried, part, "left").select(*cols, full.alias(name))


def ordinal(df: DataFrame, keys: list[str], order: str, name: str = "idx", width: int = WIDTH) -> DataFrame:
    """Number the rows of a key from 1 in ``order``."""
    return running(df, keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}, width)
