"""Joins: forward as-of, containment through shingles, positional, multiset, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.functions import arrays as A
from utterlake.operators.ordered import BLOCK, Running, running, with_block
from utterlake.session import cut_lineage

CURSOR_WIDTH = 1 << 22


def asof_forward(
    probes: DataFrame,
    marks: DataFrame,
    keys: list[str],
    probe: str,
    cursor: str,
    value: str,
    width: int = CURSOR_WIDTH,
) -> DataFrame:
    """For each probe the ``value`` of the first mark whose cursor is at or after it, else null.

    Probes below 1 count as 1. Equal probes are looked up once. Marks and distinct probes are united
    and cut into cursor blocks; within a block a descending window finds the mark, and a block without
    one takes the first mark of a later block.
    """
    target = F.greatest(F.col(probe), F.lit(1)).cast("bigint")
    asked = probes.select(*keys, target.alias("_at")).distinct()
    m = marks.select(*keys, F.col(cursor).cast("bigint").alias("_at"), F.col(value).alias("_value"))
    both = m.withColumn("_mark", F.lit(1)).unionByName(
        asked.withColumn("_mark", F.lit(0)), allowMissingColumns=True
    )
    d = with_block(both, "_at", width)
    part = [*keys, BLOCK]
    down = (
        Window.partitionBy(*part)
        .orderBy(F.desc("_at"), F.desc("_mark"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = d.select(
        *part, "_at", "_mark", F.last(F.when(F.col("_mark") == 1, F.struct("_value")), ignorenulls=True).over(down).alias("_in")
    ).where(F.col("_mark") == 0)
    firsts = d.groupBy(*part).agg(
        F.min_by(F.struct("_value"), F.when(F.col("_mark") == 1, F.col("_at"))).alias("_first")
    )
    later = (
        Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = firsts.select(*part, F.last("_first", ignorenulls=True).over(later).alias("_later"))
    answers = found.join(carried, part, "left").select(
        *keys, "_at", F.coalesce("_in", "_later")["_value"].alias(value)
    )
    return probes.withColumn("_at", target).join(answers, [*keys, "_at"], "left").drop("_at")


def sample_cursor(seconds: Column, sample_rate: int) -> Column:
    """The sample cursor of an audio position in seconds."""
    return F.ceil(F.greatest(seconds, F.lit(0.0)) * sample_rate)


def ingest_cursor(df: DataFrame, keys: list[str], order: str, count: str) -> DataFrame:
    """Half-open sample ranges (start_cursor, cursor] of chunks; negative counts add nothing."""
    n = F.greatest(F.col(count), F.lit(0)).cast("bigint")
    d = running(df, keys, order, {"cursor": Running("sum", n)})
    return d.withColumn("start_cursor", F.col("cursor") - n)


def range_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of a key from 1 in a unique order that need not be an integer column.

    Rows are range-partitioned, numbered within a partition and shifted by the counts of the key's
    partitions before. The partitioned rows are written once, so that both reads see one split.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = cut_lineage(
        df.repartitionByRange(pieces, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranked"
    )
    counts = split.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    # At most one row per key and partition.
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_p").orderBy(*order)
    return (
        split.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_p"])
        .withColumn(name, (F.col("_off") + F.col("_r")).cast("bigint"))
        .drop("_off", "_r", "_p")
    )


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number the distinct values from 0 in binary order."""
    d = range_rank(df.select(column).distinct(), [], [F.asc(column)], name)
    return d.withColumn(name, F.col(name) - 1)


def with_pieces(tokens: DataFrame, vocab: DataFrame, token: str, blank: int) -> DataFrame:
    """Piece text per token id; ids outside the vocabulary and the blank are labelled."""
    v = vocab.select(F.col("id").alias(token), "piece")
    label = (
        F.when(F.col(token) == blank, "<blank>")
        .when(F.col("piece").isNull(), "<invalid>")
        .otherwise(F.col("piece"))
    )
    return tokens.join(v, token, "left").withColumn("piece", label)


def word_counts(df: DataFrame, key: str, words: str) -> DataFrame:
    return df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def multiset_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per key: total words of both sides and the size of their multiset intersection.

    Both frames are (key, word, n), as word_counts gives them.
    """
    l_ = left.select(key, "word", F.col("n").alias("ln"))
    r_ = right.select(key, "word", F.col("n").alias("rn"))
    return (
        l_.join(r_, [key, "word"], "full_outer")
        .groupBy(key)
        .agg(
            F.coalesce(F.sum("ln"), F.lit(0)).alias("left_words"),
            F.coalesce(F.sum("rn"), F.lit(0)).alias("right_words"),
            F.sum(F.least(F.coalesce("ln", F.lit(0)), F.coalesce("rn", F.lit(0)))).alias("overlap"),
        )
    )


def positional(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pair two ordinal lists by position; ``columns`` come back as a_x and b_x."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("has_a"))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("has_b"))
    return a.join(b, keys, "full_outer")


def first_divergence(pairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """First position where a pair differs in any column, else the shorter length if lengths differ."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    d = pairs.groupBy(key).agg(
        F.count("has_a").alias("a_len"),
        F.count("has_b").alias("b_len"),
        F.min(F.when(both & ~same, F.col("idx"))).alias("mismatch"),
    )
    shorter = F.when(F.col("a_len") != F.col("b_len"), F.least("a_len", "b_len"))
    return d.select(key, "a_len", "b_len", F.coalesce("mismatch", shorter).cast("bigint").alias("first_diff"))


def neighbourhood(pairs: DataFrame, diffs: DataFrame, key: str, context: int) -> DataFrame:
    """The pairs within ``context`` positions of a key's first divergence.

    The wanted positions are enumerated (2 * context + 1 per key), so this is an equi-join.
    """
    at = F.sequence(F.greatest(F.lit(0), F.col("first_diff") - context), F.col("first_diff") + context)
    wanted = diffs.where(F.col("first_diff").isNotNull()).select(key, "first_diff", F.explode(at).alias("idx"))
    return pairs.join(wanted, [key, "idx"])


def containment(docs: DataFrame, passages: DataFrame, doc: str, passage: str, size: int = 4) -> DataFrame:
    """(doc, passage) pairs where the passage's words occur in a row in the document.

    Both frames carry ``words``. Each passage is looked up by its rarest shingle only, then verified
    on the whole word lists, so that no common phrase makes all pairs.
    """

    def shingles(k: int) -> Column:
        n = F.size("words") - k + 1
        return F.array_distinct(
            F.transform(A.count_to(n), lambda i: F.xxhash64(*[F.get("words", i + (j - 1)) for j in range(k)]))
        )

    p = passages.where(F.size("words") > 0).withColumn("k", F.least(F.lit(size), F.size("words")))
    # At most ``size`` different lengths.
    lengths = sorted(r.k for r in p.select("k").distinct().collect())

    def exploded(d: DataFrame, keep: list[str], own: bool) -> DataFrame:
        parts = [
            (d.where(F.col("k") == k) if own else d).select(*keep, F.lit(k).alias("k"), F.explode(shingles(k)).alias("h"))
            for k in lengths
        ]
        return reduce(DataFrame.unionByName, parts) if parts else d.select(*keep, F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("h")).limit(0)

    keys = exploded(p, [passage], True)
    wanted = keys.select("k", "h").distinct()
    # Only shingles that some passage has are left; written once, as two steps read them.
    grams = cut_lineage(exploded(docs, [doc], False).join(wanted, ["k", "h"], "left_semi"), "shingles")
    spread = grams.groupBy("k", "h").agg(F.count("*").alias("docs"))
    chosen = (
        keys.join(spread, ["k", "h"], "left")
        .groupBy(passage, "k")
        .agg(F.min_by("h", F.struct(F.coalesce("docs", F.lit(0)), "h")).alias("h"))
    )
    candidates = chosen.join(grams, ["k", "h"]).select(doc, passage)
    return (
        candidates.join(docs.select(doc, F.col("words").alias("doc_words")), doc)
        .join(passages.select(passage, F.col("words").alias("passage_words")), passage)
        .where(A.contains_subsequence(F.col("doc_words"), F.col("passage_words")))
        .select(doc, passage)
    )


def previous_segment(df: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """The column's value in the segment before; null in the first."""
    return running(df, keys, order, {name: Running("prev", F.col(column))})


def latest_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last write per key, aggregated before the shuffle so that a hot key's copies shrink early."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
