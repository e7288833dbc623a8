"""Filter interaction audit: what each filter removes in every order of five filters, from truth-table survival words.

A filter is a condition that makes a document fail. Each document becomes a 32-bit word: bit s is set if it survives all the
filters of subset s. Positional popcounts of these words, by carry-save adders, give the survivors of every subset per part
and label; all figures of all 120 orders are differences of survivors. Only words are counted in Python; conditions and
figures are Spark expressions.

Null texts are empty texts, a null part is the empty string. A null id is neither smaller nor larger than another and has no
label; of equal ids none is smaller, so repeated rows pass together. A document with several labels counts as good or toxic
if one of them says so. An empty table gives an empty table. Texts of any length are judged whole; other columns play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.session import cut_lineage

#: The filters of the contract, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Survival word of each set of failed filters.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def failures(df: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """_id, _part and _failed (the bits of the failed filters) of each row of df."""
    texts = df.select(F.col(id_column).alias("_id"), F.coalesce(F.col(part), F.lit("")).alias("_part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("_text")))), F.lit(0))
    judged = cut_lineage(texts.select("_id", "_part", bits.alias("_bits"), F.unhex(F.sha2("_text", 256)).alias("_sum")), "failures")
    # each text has one row of first ids, and (sum, id) spreads the copies of a text over all partitions
    first = judged.groupBy("_sum").agg(F.min("_id").alias("_id")).where("_id is not null").withColumn("_first", F.lit(True))
    copy = F.when(F.col("_id").isNotNull() & F.col("_first").isNull(), 16).otherwise(0)
    return judged.join(first, ["_sum", "_id"], "left").select("_id", "_part", (F.col("_bits") + copy).alias("_failed"))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set. Carry-save adders fold three words of a weight into one of that weight
    and one of twice the weight, until few are left."""
    counts = np.zeros(32, np.int64)
    weight = 1
    while len(words):
        carries = []
        while len(words) > 32:
            m = len(words) // 3
            a, b, c = words[:m], words[m : 2 * m], words[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * m :]])
        counts += weight * ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset per part and label in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("_part").dictionary_encode()
        flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_good", "_toxic")]
        group = parts.indices.to_numpy().astype(np.int64) * 4 + flags[0] * 2 + flags[1]
        order = np.argsort(group, kind="stable")
        words = SURVIVAL[batch.column("_failed").to_numpy()][order]
        keys, starts = np.unique(group[order], return_index=True)
        for key, own in zip(keys, np.split(words, starts[1:]), strict=True):
            n = bit_counts(own)
            good, toxic = key >> 1 & 1, key & 1
            name = pa.array([parts.dictionary[int(key) >> 2].as_py()] * SUBSETS)
            yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(SUBSETS)), pa.array(n), pa.array(n * good), pa.array(n * toxic)], names=["part", "subset", "n", "good", "toxic"])


def survivors(judged: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """part, subset and the documents, good ones and toxic ones that survive all filters of the subset."""
    known = labels.groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    marked = judged.join(known, "_id", "left").select("_part", "_failed", flag("_good"), flag("_toxic"))
    counted = marked.mapInArrow(_count_words, "part string, subset long, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _steps() -> list[dict]:
    """Every step of every order, with the subsets before and after it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            out.append({"filter_order": "".join(order), "step": k, "own": own, "before": before, "after": before | own})
            before |= own
    return out


def audit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per
    part, order and step."""
    counts = survivors(failures(df, id_column, text, part), labels, id_column)
    tables = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", "good", "toxic")))).alias("_left"))
    left = lambda subset, what: F.col("_left")[subset.cast("long")][what]
    steps = _steps()
    kind = "array<struct<filter_order string, step int, own int, before int, after int>>".replace(" string", ":string").replace(" int", ":int")
    rows = tables.select("part", "_left", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    before, after, own = F.col("before"), F.col("after"), F.col("own")
    full, none = F.lit(SUBSETS - 1), F.lit(0)
    lost = lambda what: left(before, what) - left(after, what)
    pairs = [[(s["before"], s["after"]) for s in steps if s["own"] == 1 << k] for k in range(len(FILTERS))]
    share = {1 << k: {p: pairs[k].count(p) for p in sorted(set(pairs[k]))} for k in range(len(FILTERS))}
    shapley = F.coalesce(*[F.when(own == k, sum((F.lit(n) * (left(F.lit(a), "n") - left(F.lit(b), "n")) for (a, b), n in w.items()), F.lit(0))) for k, w in share.items()])
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
        left(after, "n").alias("kept"),
        lost("n").alias("removed"),
        (left(none, "n") - left(own, "n") - lost("n")).alias("redundant"),
        (left(full - own, "n") - left(full, "n")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.cast("long").alias("shapley"),
    )
