"""Document fingerprints: a quartile bucket digest of byte triplets.

Each text's triplets (three patterns in a window of five bytes) are hashed into 128 buckets. A bucket's count is coded by the quartile
it falls in (two bits); two more bytes hold the logarithm of the length and the ratios of the quartiles. Two digests are
compared with a bounded difference score.

Null texts count as empty; a text of under five bytes has no triplets and an all-zero body. Equal texts have equal
fingerprints. An empty table gives an empty table, repeated rows stand next to each other in the order, and new columns
replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.session import cut_lineage

BUCKETS = 128
#: Byte offsets of the triplets in the window.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Differences from this value on count as no likeness.
FAR = 320
_TABLE = np.random.default_rng(128).permutation(256).astype(np.uint8)
_PAIR = _TABLE[_TABLE[np.arange(1 << 16) >> 8] ^ (np.arange(1 << 16) & 255).astype(np.uint8)]
#: Difference of two quartile codes; opposite ends count double.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)
_BYTE_STEP = sum(_STEP[(np.arange(256)[:, None] >> s) & 3, (np.arange(256)[None, :] >> s) & 3] for s in (0, 2, 4, 6))


def digests(texts) -> np.ndarray:
    """The digests of a string column, as rows of 34 bytes."""
    out = np.zeros((len(texts), BUCKETS // 4 + 2), np.uint8)
    for i, j, data, offs in K.text_chunks(texts):
        n, docs = len(data), j - i
        counts = np.zeros(docs * BUCKETS, np.int64)
        if n >= 5:
            m = n - 4
            base = np.repeat(np.arange(docs, dtype=np.int32) * BUCKETS, np.diff(offs))[:m]
            inside = np.arange(m) + 5 <= np.repeat(offs[1:], np.diff(offs))[:m]
            for salt, (a, b, c) in enumerate(PATTERNS):
                pair = (data[a : a + m].astype(np.uint16) << 8) | data[b : b + m]
                h = _TABLE[_PAIR[pair] ^ data[c : c + m] ^ np.uint8(salt * 85)] >> 1
                counts += np.bincount((base + h)[inside], minlength=docs * BUCKETS)
        counts = counts.reshape(docs, BUCKETS)
        quart = np.partition(counts, (31, 63, 95), axis=1)[:, (31, 63, 95)]
        code = (counts[:, :, None] > quart[:, None, :]).sum(2).astype(np.uint8)
        out[i:j, 2:] = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
        out[i:j, 0] = np.minimum(255, np.floor(np.log2(np.diff(offs) + 1) * 6))
        q3 = np.maximum(quart[:, 2], 1)
        out[i:j, 1] = (quart[:, 0] * 15 // q3).astype(np.uint8) << 4 | (quart[:, 1] * 15 // q3).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 for a difference score of FAR or more."""
    diff = _BYTE_STEP[a[:, 2:], b[:, 2:]].sum(1)
    diff = diff + np.abs(a[:, 0].astype(np.int64) - b[:, 0]) * 2
    diff += np.abs((a[:, 1] >> 4).astype(np.int64) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15).astype(np.int64) - (b[:, 1] & 15))
    return 1 - np.minimum(diff, FAR) / FAR


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the hexadecimal fingerprint of its texts."""

    @F.pandas_udf("string")
    def one(s):
        return s.__class__([x.tobytes().hex() for x in digests(pa.array(s, pa.string(), from_pandas=True))], index=s.index)

    return df.withColumn(name, one(F.col(text)))


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns, 0 to 1; null if one is null."""

    @F.pandas_udf("double")
    def one(x, y):
        both = (x.notna() & y.notna()).to_numpy()
        out = x.__class__(np.full(len(x), np.nan), index=x.index).astype("Float64")
        rows = [np.frombuffer(bytes.fromhex("".join(s[both])), np.uint8).reshape(-1, BUCKETS // 4 + 2) for s in (x, y)]
        out[:] = None
        out[both] = likeness(*rows)
        return out

    return one(a, b)


_RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(texts: list[str], nexts: list[str]) -> list[pa.Array]:
    """Result columns for texts and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
    own, new = digests(pa.array(texts, pa.large_string())), digests(pa.array(edited, pa.large_string()))
    follow = digests(pa.array(nexts, pa.large_string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array([x.tobytes().hex() for x in own]),
        pa.array([x.tobytes().hex() for x in new]),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, follow)),
    ]


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted partition; its first and last text go out too, as the neighbours are in other partitions."""
    held = None

    def edge(role: int, ids, text: str, part: int) -> pa.RecordBatch:
        rest = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([ids, *rest, pa.array([part], pa.int32()), pa.array([role], pa.int32()), pa.array([text])], names=["doc_id", *_NAMES, "_part", "_role", "_text"])

    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            ids, texts = part.column("doc_id"), part.column("_text").to_pylist()
            p = part.column("_part")[0].as_py()
            if held is None:
                yield edge(0, ids.slice(0, 1), texts[0], p)
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            if len(texts) > 1:
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(0, n), *_compare(texts[:-1], texts[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
                    names=["doc_id", *_NAMES, "_part", "_role", "_text"],
                )
            held = (ids.slice(len(ids) - 1, 1), texts[-1], p)
    if held is not None:
        yield edge(1, *held)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            cols = _compare(batch.column("_text").to_pylist(), batch.column("_next").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *_NAMES])


def edit_likeness(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare with that and with the next document's.

    The next document is the one with the next lower id (null ids last, equal ids by a hash of the text); after the last comes
    the first. The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next.
    Texts are range-partitioned once; only the texts at the borders of partitions move again.
    """
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    result = _RESULT.format(id=kind)
    done = parts.select("doc_id", "_text", "_part").mapInArrow(_neighbour_rows, f"{result}, _part int, _role int, _text string")
    done = cut_lineage(done, "fingerprints")
    edges = done.where("_role is not null")
    # one number for each partition; the last is followed by the first
    heads = edges.where("_role = 0").select("_part")
    every = Window.orderBy("_part")
    follow = heads.select(
        "_part", F.coalesce(F.lead("_part").over(every), F.min("_part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_follow")
    )
    tails = edges.where("_role = 1").select("doc_id", "_part", "_text").join(follow, "_part")
    firsts = edges.where("_role = 0").select(F.col("_part").alias("_follow"), F.col("_text").alias("_next"))
    pairs = tails.join(firsts, "_follow").select("doc_id", "_text", "_next").mapInArrow(_pair_rows, result)
    return done.where("_role is null").select("doc_id", *_NAMES).unionByName(pairs)
