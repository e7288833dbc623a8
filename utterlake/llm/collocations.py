"""Phrase collocations by dynamic itemset counting over cyclic scans of corpus shards.

The texts are cut into pieces at punctuation and dealt to shards, which are scanned in turn, again and again. Words are counted
in the first cycle. A longer phrase is counted from the scan after that by which both its subphrases (all but its last word,
all but its first) have reached the threshold, and for one full cycle, so lengths interleave. The counters are kept by hash,
as arrays that Spark partitions by ranges of it and merges after each scan; those that have ended their cycle below the
threshold go. What has reached it is also set in a bitmap of fixed size, broadcast before each scan. Clashes of hashes or
bits only make a phrase active too early. A last pass counts the phrases found by their words, exactly.

Null texts are empty, a null language is `und`; an empty table gives an empty table; repeated rows count each time; other
columns play no part. A text is one cell and is cut as a whole; ties of the final order cannot occur, as phrases differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.session import cut_lineage, release, scratch, used_scratch

#: Fixed values of the contract: what ends a piece, and what separates words within one.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are cut into words at once, and counters that a task gathers before it sends them on.
CHUNK = 2 << 20
GATHERED = 1 << 19


class Pieces:
    """The words of a chunk of texts: their own numbers, one per language and word, and which neighbours share a piece."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: np.ndarray, names: pa.Array):
        data = LOWER[data]
        apart = ENDS[data] | SPACES[data]
        first, last = ~apart, ~apart
        first[1:] &= apart[:-1]
        last[:-1] &= apart[1:]
        edges = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
        first[edges] = ~apart[edges]
        last[edges - 1] = ~apart[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(offs, start, "right") - 1
        ends = np.concatenate(([0], np.cumsum(ENDS[data])))
        #: whether a word and the next one are in the same piece
        self.joined = (doc[1:] == doc[:-1]) & (ends[start[1:]] == ends[start[:-1]]) if len(start) else np.zeros(0, bool)
        borders = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(borders), pa.py_buffer(data[~apart])])
        coded = words.dictionary_encode()
        both, self.word = np.unique(langs[doc] * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_inverse=True)
        take = both % max(len(coded.dictionary), 1)
        self.texts = coded.dictionary.take(pa.array(take))
        lang = both // max(len(coded.dictionary), 1)
        self.langs = names.take(pa.array(lang))
        self.hash = hashes(self.texts, self.langs)


def hashes(texts: pa.Array, langs: pa.Array) -> np.ndarray:
    """64-bit hash of each text in its language."""
    out = []
    for a in (texts, langs):
        data, offs = K.buffers(a)
        out.append(K.span_hash(data, offs[:-1], offs[1:]))
    return K.mix(out[0] + K.mix(out[1]) * np.uint64(3))


class Bitmap:
    """A set of hashes, as bits of a fixed number of 64-bit cells; it may hold more than was put in, never less."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def __reduce__(self):
        # few bits are set in most, and what is broadcast lies on the disk of every executor
        return _unpacked, (zlib.compress(self.cells.tobytes(), 1),)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h % np.uint64(64 * len(self.cells))
        return (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _unpacked(data: bytes) -> Bitmap:
    return Bitmap(np.frombuffer(zlib.decompress(data), np.uint64))


class Phrases:
    """The phrases of a chunk by length: hashes, counts, and what they are made of."""

    def __init__(self, pieces: Pieces, keep: list):
        """keep[k - 1] tells which of the given phrases of k words stay, by (own hashes, hashes of head, hashes of tail)."""
        self.pieces, self.found = pieces, {}
        n, word_hash = len(pieces.texts), pieces.hash
        if not n:
            return
        chosen = np.flatnonzero(keep[0](word_hash, None, None))
        self.found[1] = (chosen, word_hash[chosen], np.bincount(pieces.word, minlength=n)[chosen])
        at = np.flatnonzero(pieces.joined)
        keys, pair = np.unique(pieces.word[at] * n + pieces.word[at + 1], return_inverse=True)
        self.first, self.second = keys // n, keys % n
        a, b = word_hash[self.first], word_hash[self.second]
        pair_hash = K.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
        # pairs that may be in a longer phrase, whether they are counted themselves or not
        chosen = np.flatnonzero(keep[1](pair_hash, a, b))
        self.found[2] = (chosen, pair_hash[chosen], np.bincount(pair, minlength=len(keys))[chosen])
        three = np.flatnonzero(at[1:] == at[:-1] + 1)
        left, right = pair[three], pair[three + 1]
        three_hash = K.mix(pair_hash[left] * np.uint64(0xC2B2AE3D27D4EB4F) + word_hash[self.second[right]])
        live = keep[2](three_hash, pair_hash[left], pair_hash[right])
        keys, which, count = np.unique(left[live] * n + self.second[right[live]], return_index=True, return_counts=True)
        self.head, self.tail = keys // n, keys % n
        self.found[3] = (np.arange(len(keys)), three_hash[live][which], count)

    def texts(self, size: int) -> tuple[pa.Array, pa.Array]:
        """Languages and words of the phrases found."""
        take = lambda i: self.pieces.texts.take(pa.array(i))
        join = lambda x, y: pc.binary_join_element_wise(x, y, pa.scalar(b" ", pa.large_binary()))
        chosen = self.found[size][0]
        if size == 1:
            first, text = chosen, take(chosen)
        elif size == 2:
            first = self.first[chosen]
            text = join(take(first), take(self.second[chosen]))
        else:
            first = self.first[self.head]
            text = join(join(take(first), take(self.second[self.head])), take(self.tail))
        return self.pieces.langs.take(pa.array(first)), text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        langs, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        for i, j, data, offs in K.text_chunks(batch.column("text"), CHUNK):
            yield Pieces(data, offs, langs[i:j], names)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes and the sums of their counts."""
    order = np.argsort(h)
    h = h[order]
    first = K.group_starts(h)
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


def scan(shard: DataFrame, now: list[Bitmap], past: list[Bitmap] | None, ranges: int) -> DataFrame:
    """size, range, hashes and counts of the phrases that a scan of one shard counts: those active now, without those that were
    active a cycle ago already, which have ended their own."""
    maps = shard.sparkSession.sparkContext.broadcast((now[:2], past and past[:2]))

    def active(held: list[Bitmap] | None, size: int):
        return (lambda a, b: held[size - 2].has(a) & held[size - 2].has(b)) if held else (lambda a, b: np.zeros(len(a), bool))

    def cut(found: dict) -> Iterator[pa.RecordBatch]:
        for size, parts in found.items():
            if not parts:
                continue
            h, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            edges = np.searchsorted(h, np.array([k * ((1 << 64) // ranges + 1) for k in range(1, ranges)], np.uint64))
            rows = [(size, k, x.tobytes(), y.astype(np.int64).tobytes()) for k, (x, y) in enumerate(zip(np.split(h, edges), np.split(n, edges), strict=True)) if len(x)]
            parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["size", "range", "hashes", "counts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = maps.value
        keep = [lambda h, a, b: np.full(len(h), before is None)]
        keep += [lambda h, a, b, k=k: active(own, k)(a, b) & ~active(before, k)(a, b) for k in (2, 3)]
        found, held = {1: [], 2: [], 3: []}, 0
        for pieces in _chunks(batches):
            for size, (_, h, n) in Phrases(pieces, keep).found.items():
                if len(h):
                    found[size].append((h, n))
                    held += len(h)
            if held > GATHERED:
                yield from cut(found)
                held = 0
        yield from cut(found)

    return shard.mapInArrow(rows, "size int, range int, hashes binary, counts binary")


def _merge(least: int, scans: int, t: int, cells: int):
    """New counters of one range and length from the old ones and a scan's; and the bits of those that have reached the threshold.
    A counter is (hash, count, scan in which it began)."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        kind = (np.uint64, np.int64, np.int16)
        held = [np.concatenate([np.frombuffer(b, k) for b in old.column(c).to_pylist()] or [np.zeros(0, k)]) for c, k in zip(("hashes", "counts", "starts"), kind, strict=True)]
        more = [np.concatenate([np.frombuffer(b, k) for b in new.column(c).to_pylist()] or [np.zeros(0, k)]) for c, k in zip(("hashes", "counts"), kind, strict=False)]
        h = np.concatenate([held[0], more[0]])
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = K.group_starts(h)
        n = np.add.reduceat(np.concatenate([held[1], more[1]])[order], first) if len(h) else np.zeros(0, np.int64)
        starts = np.concatenate([held[2], np.full(len(more[0]), t, np.int16)])[order][first]
        h = h[first]
        reached = n >= least
        at = h[reached] % np.uint64(64 * cells)
        order = np.argsort(at)
        at = at[order]
        cell = (at >> np.uint64(6)).astype(np.int64)
        lead = K.group_starts(cell)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), lead) if len(at) else np.zeros(0, np.uint64)
        open_ = reached | (starts + scans > t + 1)
        some = (old if len(old) else new).slice(0, 1)
        row = [x.tobytes() for x in (h[open_], n[open_], starts[open_], cell[lead], bits)]
        return pa.table([some.column("size"), some.column("range"), *[pa.array([b], pa.binary()) for b in row]], names=["size", "range", "hashes", "counts", "starts", "cells", "bits"])

    return run


COUNTERS = "size int, range int, hashes binary, counts binary, starts binary, cells binary, bits binary"


def reached_maps(counters: DataFrame, cells: int) -> list[Bitmap]:
    """Bitmaps of the phrases of one to three words that have reached the threshold; ranges are joined by bit."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, c, b in zip(batch.column("size").to_pylist(), batch.column("cells").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                cell = np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), size, np.int32)), pa.array(cell), pa.array(np.frombuffer(b, np.int64))], names=["size", "cell", "bits"])

    got = counters.select("size", "cells", "bits").mapInArrow(unpack, "size int, cell long, bits long").groupBy("size", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = [np.zeros(cells, np.uint64) for _ in range(3)]
    which, cell, value = (got.column(k).to_numpy() for k in range(3))
    for k in range(3):
        own = which == k + 1
        out[k][cell[own]] = value[own].astype(np.int64).view(np.uint64)
    return [Bitmap(c) for c in out]


def named_counts(texts: DataFrame, found: list[Bitmap]) -> DataFrame:
    """lang, size, phrase, f: exact counts of the phrases found, by their words; size 0 has the number of all words."""
    maps = texts.sparkSession.sparkContext.broadcast(found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = maps.value
        keep = [lambda h, a, b, k=k: held[k].has(h) for k in range(3)]
        for pieces in _chunks(batches):
            phrases = Phrases(pieces, keep)
            names, index = np.unique(pieces.langs.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            total = np.bincount(index[pieces.word], minlength=len(names)).astype(np.int64)
            out = [(pa.array(names.tolist(), pa.string()), 0, pa.array([""] * len(names), pa.string()), total)]
            for size, (_, _, n) in phrases.found.items():
                lang, text = phrases.texts(size)
                out.append((lang, size, text.cast(pa.large_string()).cast(pa.string()), n.astype(np.int64)))
            for lang, size, text, n in out:
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), size, np.int32)), text, pa.array(n)], names=["lang", "size", "phrase", "f"])

    return texts.mapInArrow(rows, "lang string, size int, phrase string, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, shards: int = 3, cells: int = 1 << 19, range_bytes: int = 16 << 20) -> DataFrame:
    """lang, size (1 to 3), phrase, f: exact counts of the phrases that occur at least `least` times; size 0 has the number of
    all words of a language.

    shards is the number of scans in a cycle, cells the number of 64-bit cells in each bitmap; a range of counters is made for
    each range_bytes of text.
    """
    spark = df.sparkSession
    dealt = df.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("_shard")
    ).where("text <> ''")
    path = scratch(spark, "shards")
    dealt.write.option("compression", "zstd").partitionBy("_shard").parquet(path)
    texts = spark.read.schema("lang string, text string, _shard int").parquet(path)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-total // range_bytes))
    history = [[Bitmap(np.zeros(cells, np.uint64)) for _ in range(3)]]  # history[t]: what had reached the threshold before scan t
    counters, old = spark.createDataFrame([], COUNTERS), []
    same = lambda a, b: all(np.array_equal(x.cells, y.cells) for x, y in zip(a[:2], b[:2], strict=True))
    t = 0
    while t < shards or not same(history[t], history[t - shards]):
        shard = texts.where(F.col("_shard") == t % shards).select("lang", "text")
        new = scan(shard, history[t], history[t - shards] if t >= shards else None, ranges)
        keys = ["size", "range"]
        merged = counters.groupBy(*keys).cogroup(new.groupBy(*keys)).applyInArrow(_merge(least, shards, t, cells), COUNTERS)
        mark = len(used_scratch())
        counters = cut_lineage(merged, "counters")
        release(spark, old)
        old = used_scratch()[mark:]
        t += 1
        history.append(reached_maps(counters, cells))
    out = cut_lineage(named_counts(texts.select("lang", "text"), history[t]).where((F.col("size") == 0) | (F.col("f") >= least)), "phrases")
    release(spark, [path, *old])
    return out


def _part(phrase: Column, start: Column | int, n: Column | int) -> Column:
    """n words of a phrase from the start-th."""
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, absorbed: int = 50, scale: int = 1000000, shards: int = 3, cells: int = 1 << 19) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of two or three words of each language, by the score of their
    weakest cut. Phrases inside a longer candidate with at least `absorbed` percent of their count are left out."""
    counts = phrase_counts(df, text, lang, least, shards, cells)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("size > 0")
    found = known.where("size > 1").withColumnRenamed("f", "a")
    # both cuts of each candidate, with the counts of their sides
    cut = found.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"_left": _part(F.col("phrase"), F.lit(1), F.col("_k")), "_right": _part(F.col("phrase"), F.col("_k") + 1, F.col("size") - F.col("_k"))})
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # a <= l and a <= r, so the quotient is at most `scale`, whatever the products
    cut = cut.withColumns({"_top": (wide("a") * wide("a")).cast("decimal(38,0)") * F.lit(scale).cast("decimal(7,0)"), "_under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    cut = cut.withColumn("score", F.expr("_top div _under").cast("long"))
    scored = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    # the largest count of a longer candidate around each phrase
    inside = found.where("size = 3").select("lang", "a", F.explode(F.array(_part(F.col("phrase"), 1, 2), _part(F.col("phrase"), 2, 2))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("_around").isNull() | (F.lit(100) * F.col("_around") < F.lit(absorbed) * F.col("a")))
    flat = left.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    # the best of each slice of a language first, so that no task ranks all phrases of one
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slice_ = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = flat.withColumn("rank", F.row_number().over(slice_.orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
