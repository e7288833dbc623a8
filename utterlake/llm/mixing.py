"""Mixing sources to target weights.

1. Targets: the sources, in code point order with null last, take the weights in turn and share `share` of all words by
   them. A target is at most `most` times its source's words; what is above is shared again by weight among the others until none
   is above. Each round is one aggregate of three numbers.
2. The words of a source's documents are laid end to end in a seeded order and cut into blocks of `block` words (the last
   one may be shorter).
3. A source gets as many slots as its target has blocks. Each slot draws its output shard by a seeded hash, so the counts
   of the sources in a shard are multinomial, with the targets kept in total. Slot j maps to block perm(j mod blocks),
   where perm is a seeded permutation of the source's blocks, another for each time round; as a target is at most
   twice its source, no block is taken a third time.
4. Slots and blocks are joined by index; a slot gives a piece of each document its block lies in.

Null texts have no words and take no part beyond their row; an empty table gives an empty table; repeated rows are documents of
their own. Nothing depends on the partitioning of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.operators.joins import range_rank
from utterlake.session import cut_lineage


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of [0, size) at each index: four Feistel rounds, repeated while the result is outside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    size = size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (K.mix(right ^ K.mix(k + np.uint64(r + 1))) & m)
        x = (left << h) | right
        out[todo] = x
        todo = todo[x >= size[todo]]
    return out.astype(np.int64)


def _word_counts(text: str, name: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counts = np.zeros(len(column), np.int64)
            for i, j, data, offs in K.text_chunks(column):
                counts[i:j] = K.Words(data, offs, hashed=False).count
            others = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(counts)], names=[*others, name])

    return rows


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, _id) from (source, source_size)."""
    ranked = range_rank(sizes, [], [F.col("source").asc_nulls_last()], "_id")
    turn = F.pmod(F.col("_id") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumns({"_weight": weight, "_cap": F.lit(float(most)) * F.col("source_size")}), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    rate, full = 0.0, None
    while True:
        # sources whose share is above their limit stay at it; the rest is shared anew among the others
        capped = F.col("_weight") * rate >= F.col("_cap") if full is not None else F.lit(False)
        row = ranked.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if row.n == full or not row.weights:
            break
        full, rate = row.n, (total - row.caps) / row.weights
    return ranked.select("source", "source_size", F.least("_cap", F.lit(rate) * F.col("_weight")).alias("target"), "_id")


def _laid_out(docs: DataFrame, seed: int) -> DataFrame:
    """_begin: words of the source before each document, in a seeded order. A source may be spread over many partitions."""
    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
    split = docs.repartitionByRange(pieces, "_id", "_h").withColumn("_p", F.spark_partition_id())
    split = cut_lineage(split, "laid-out")
    sums = split.groupBy("_id", "_p").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_id", "_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_id", "_p").orderBy("_h", "_row")
    inside = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(starts, ["_id", "_p"]).withColumn("_begin", F.col("_in") + F.col("_start")).drop("_in", "_start", "_h")


def _slot_rows(block: int, seed: int, shard_slots: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, blocks, first, count, shards in zip(*[batch.column(c).to_pylist() for c in ("_id", "_blocks", "_first", "_count", "_shards")], strict=True):
                j = first + np.arange(count, dtype=np.int64)
                turn = j // blocks
                key = K.mix(np.uint64(seed) + K.mix(np.full(count, s, np.uint64) * np.uint64(8) + turn.astype(np.uint64)))
                at = permute(j % blocks, np.full(count, blocks, np.int64), key)
                out = K.mix(K.mix(j.astype(np.uint64) + np.uint64(1)) ^ key) % np.uint64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, s)), pa.array(at), pa.array(turn.astype(np.int32)), pa.array(j), pa.array(out.astype(np.int64))], names=["_id", "_block", "turn", "slot", "out_shard"])

    return rows


def mix_sources(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 32,
    shard_slots: int = 1 << 16,
    seed: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: _row, the id, source, size, source_size, target, _begin, one row for each of df. pieces: out_shard, slot, turn, _row,
    first, n: the n words from word `first` on of document _row stand in that slot of the mix, where the source is gone through
    for the turn-th time. _row is a column of df if it has one.
    """
    spark = df.sparkSession
    row = F.col("_row") if "_row" in df.columns else F.monotonically_increasing_id().alias("_row")
    sized = df.select(row, F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text")).mapInArrow(
        _word_counts("_text", "size"), f"_row long, doc_id {df.schema[id_column].dataType.simpleString()}, source {df.schema[source].dataType.simpleString()}, size long"
    )
    sized = cut_lineage(sized, "sizes")
    sources = cut_lineage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    docs = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    docs = cut_lineage(_laid_out(docs, seed), "documents")

    blocks = F.ceil(F.col("source_size") / block)
    slots = F.least(F.round(F.col("target") / F.col("source_size") * blocks), 2 * blocks).cast("long")
    plan = sources.where("source_size > 0").select("_id", blocks.cast("long").alias("_blocks"), slots.alias("_slots"))
    total = plan.agg(F.coalesce(F.sum("_slots"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_slots))
    step = 1 << 15
    chunk = plan.where("_slots > 0").select("_id", "_blocks", "_slots", F.explode(F.sequence(F.lit(0), F.expr(f"(_slots - 1) div {step}"))).alias("_c"))
    chunk = chunk.select("_id", "_blocks", (F.col("_c") * step).alias("_first"), F.least(F.lit(step), F.col("_slots") - F.col("_c") * step).alias("_count"), F.lit(shards).alias("_shards"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = chunk.repartition(n, "_id", "_first").mapInArrow(_slot_rows(block, seed, shard_slots), "_id long, _block long, turn int, slot long, out_shard long")

    last = F.expr(f"(_begin + size - 1) div {block}")
    parts = docs.where("size > 0").select("_row", "_id", "_begin", "size", F.explode(F.sequence(F.expr(f"_begin div {block}"), last)).alias("_block"))
    first = F.greatest(F.col("_begin"), F.col("_block") * block)
    end = F.least(F.col("_begin") + F.col("size"), (F.col("_block") + 1) * block)
    parts = parts.select("_id", "_block", "_row", (first - F.col("_begin")).alias("first"), (end - first).alias("n"))
    # few rows become many in Python, which sizes at run time do not show, so no side may be broadcast
    return docs, drawn.join(parts.hint("merge"), ["_id", "_block"]).select("out_shard", "slot", "turn", "_row", "first", "n")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document that the mix takes, repeats counted), _row."""
    docs, pieces = mix_sources(df, **options)
    taken = pieces.groupBy("_row").agg(F.sum("n").alias("_taken"))
    return docs.join(taken, "_row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"), "_row")


def _taken_rows(names: list[str], text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("_parts").to_pylist()
            texts: list[str] = []
            for i, j, data, offs in K.text_chunks(batch.column(text)):
                w = K.Words(data, offs, hashed=False)
                for d in range(i, j):
                    a = int(w.offs[d - i])
                    pick = [k for first, n in sorted((x["first"], x["n"]) for x in parts[d]) for k in range(a + first, a + first + n)]
                    texts.append(b" ".join([data[x:y].tobytes() for x, y in zip(w.start[pick].tolist(), w.end[pick].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return rows


def mixed_texts(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """What the mix takes of each row of df, as its columns and turn: the row's words in blocks taken in that turn, joined by spaces.

    A row of which a turn takes nothing is not there in that turn. Rows are written once, so that both readers see the same numbers, and
    moved once.
    """
    rows = cut_lineage(df.drop("turn", "_row").withColumn("_row", F.monotonically_increasing_id()), "rows")
    _, pieces = mix_sources(rows, text=text, **options)
    parts = pieces.groupBy("_row", "turn").agg(F.collect_list(F.struct("first", "n")).alias("_parts"))
    names = [*[c for c in rows.columns if c != "_row"], "turn"]
    schema = ", ".join(f"`{c}` {'int' if c == 'turn' else rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.join(parts, "_row").select(*names, "_parts").mapInArrow(_taken_rows(names, text), schema)
