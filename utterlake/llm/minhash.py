"""Near-duplicate classes by ProbMinHash, banding and verification.

1. Equal texts are folded into one row. The signature of a text is ProbMinHash over its shingles of `size` words, weighted by how
   often they occur: each shingle's arrivals are a Poisson process of its weight, each arrival picks a register, a register
   keeps the first, and a shingle ends once its next arrival comes after all registers are set. A text in which a shingle occurs
   more than once has a second signature with all weights 1, which stands for plain Jaccard similarity as the first does for the other.
2. `rows` registers make a band; texts with an equal band, in either signature, are candidates. Two bits of each of the `registers` go along as a sketch: two
   texts of similarity 0.8 differ in 15 % of the places, and a pair that differs in five standard deviations more in both signatures
   is none.
3. Stars: the member with most company over all its bands and the one with the smallest hash lead a band group. A text is checked
   against the first `leaders` of either kind over all its groups, and links join classes.
4. What is left, band groups with members in several classes, is gathered and counted: a product of incidence matrices gives the common
   shingles of all members, and only links between classes go out. A group of over `block` members is cut into blocks, and every
   two blocks meet. So no candidate link between two classes is missed, and no pairs are written.
5. A link is a probability Jaccard or a plain Jaccard similarity of the shingles of `least` or more, counted on whole texts.

Null texts and texts of fewer than `size` words have no shingles: only equal texts are in one class with them. An empty table
gives an empty table; repeated rows share a class. New columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.llm.spans import distinct_texts, with_key
from utterlake.session import cut_lineage


def shingles(w: K.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each different shingle of each text, sorted by text and hash, and the offsets of the texts."""
    docs, n = len(w.count), len(w.hash)
    m = max(0, n - size + 1)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - m :]) if m else np.zeros(0, np.int64)
    h = K.part_hash(K.prefix_hash(w.hash), at, at + size)
    doc = w.doc[at]
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(h)))
    h, doc = h[first], doc[first]
    return doc, h, weight, np.searchsorted(doc, np.arange(docs + 1))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The registers of each text: the hash of the shingle that reached each first. 0 for texts without shingles."""
    best = np.full(docs * registers, np.inf)
    who = np.zeros(docs * registers, np.uint64)
    live = np.arange(len(h))
    when = np.zeros(len(h))
    step = 0
    while len(live):
        step += 1
        draw = K.mix(h[live] + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        when = when - np.log(_uniform(draw)) / weight[live]
        slot = doc[live] * registers + (K.mix(draw) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(when < best[slot])
        # of several arrivals at one register the earliest counts: written last
        order = better[np.argsort(-when[better], kind="stable")]
        best[slot[order]] = when[order]
        who[slot[order]] = h[live[order]]
        # a shingle is done when its next arrival can't be the first at any register
        limit = best.reshape(docs, registers).max(1)
        go = when < limit[doc[live]]
        live, when = live[go], when[go]
    return who.reshape(docs, registers)


def _band_keys(sig: np.ndarray, bands: int, rows_: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows_):
            key = K.mix(key * np.uint64(31) + sig[:, b * rows_ + r])
        keys[:, b] = key
    return keys


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each register, 32 to a word."""
    bits = (K.mix(sig) >> np.uint64(62)).reshape(len(sig), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(bits, 2).view(np.int64)


def _band_rows(size: int, bands: int, rows_: int, registers: int):
    words = registers // 32
    names = ["_k1", "_k2", "_bands", *[f"_{s}{k}" for s in "sp" for k in range(words)]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in K.text_chunks(batch.column("_text"), K.CHUNK // 2):
                doc, h, weight, at = shingles(K.Words(data, offs), size)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                sig = signatures(doc, h, weight, j - i, registers)[some]
                # the same with all weights 1: it differs in texts with a repeated shingle only
                heavy = np.zeros(j - i, bool)
                heavy[doc[weight > 1]] = True
                of = heavy[doc]
                plain = sig.copy()
                plain[heavy[some]] = signatures((np.cumsum(heavy) - 1)[doc[of]], h[of], np.ones(int(of.sum()), np.int64), int(heavy.sum()), registers)
                keys = np.concatenate((_band_keys(sig, bands, rows_), _band_keys(plain, bands, rows_)), 1)
                own = np.ones(keys.shape, bool)
                own[:, bands:] = keys[:, bands:] != keys[:, :bands]
                ends = np.concatenate(([0], np.cumsum(own.sum(1)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[own].view(np.int64)))
                pick = pa.array(some + i)
                sketch = np.concatenate((_sketch(sig), _sketch(plain)), 1)
                yield pa.RecordBatch.from_arrays([batch.column("_k1").take(pick), batch.column("_k2").take(pick), lists, *[pa.array(x) for x in sketch.T]], names=names)

    return rows


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the plain and the probability Jaccard similarity of two (sorted hashes, weights)."""
    common, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    if a[1].max() == 1 and b[1].max() == 1:
        return plain
    # sum over common elements of 1 / sum over all of max(a_j / a_i, b_j / b_i), by the order of the ratios a_j / b_j
    wa = np.concatenate((a[1], np.zeros(len(b[0]) - len(common), np.int64))).astype(float)
    other = np.ones(len(b[0]), bool)
    other[y] = False
    wb = np.zeros(len(wa))
    wb[x] = b[1][y]
    wb[len(a[0]) :] = b[1][other]
    wa[len(a[0]) :] = 0
    ratio = np.full(len(wa), np.inf)
    np.divide(wa, wb, out=ratio, where=wb > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, ca, cb = ratio[order], np.cumsum(wa[order]), np.cumsum(wb[order])
    hit = np.flatnonzero((ratio > 0) & np.isfinite(ratio))
    # elements of a smaller or equal ratio count as b_j / b_i, those of a larger one as a_j / a_i
    last = np.searchsorted(ratio, ratio[hit], "right") - 1
    prob = float(np.sum(1 / (cb[last] / wb[order][hit] + (ca[-1] - ca[last]) / wa[order][hit])))
    return max(plain, prob)


def _check_rows(size: int, least: float):
    def sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for _, _, data, offs in K.text_chunks(texts):
            _, h, weight, at = shingles(K.Words(data, offs), size)
            out += [(h[a:b], weight[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                ok = [similarity(a, b) >= least for a, b in zip(sets(part.column("_ta")), sets(part.column("_tb")), strict=True)]
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in ("_a", "_b")], names=["_a", "_b"])

    return rows


def _group_rows(size: int, least: float):
    """Links between classes in each group; rows come sorted by group."""

    def links(rows: list[tuple]) -> list[tuple]:
        ids = np.array([r[0] for r in rows], np.int64)
        kind = np.array([r[1] for r in rows], np.int64)
        if (kind == kind[0]).all():
            return []
        sets = []
        for _, _, data, offs in K.text_chunks(pa.array([r[2] for r in rows], pa.large_string())):
            _, h, weight, at = shingles(K.Words(data, offs), size)
            sets += [(h[a:b], weight[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        count = np.array([len(x[0]) for x in sets])
        every, doc = np.concatenate([x[0] for x in sets]), np.repeat(np.arange(len(sets)), count)
        order = np.argsort(every)
        first = K.group_starts(every[order])
        times = np.diff(np.append(first, len(every)))
        column = np.repeat(np.cumsum(times > 1) - 1, times)
        often = np.repeat(times > 1, times)
        share = np.concatenate([x[1] / x[1].sum() for x in sets]).astype(np.float32)
        doc, column, share = doc[order][often], column[often], share[order][often]
        common, mass = (np.zeros((len(sets), len(sets)), np.float32) for _ in range(2))
        heavy = np.array([x[1].max() > 1 for x in sets])
        step = 4096
        cut = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + step, step)) if len(column) else [0]
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            has = np.zeros((len(sets), step), np.float32)
            has[doc[a:b], column[a:b] - k * step] = 1
            common += has @ has.T
            if heavy.any():
                of = np.zeros((len(sets), step), np.float32)
                of[doc[a:b], column[a:b] - k * step] = share[a:b]
                mass += of @ has.T
        plain = common / (count[:, None] + count[None, :] - common)
        apart = np.triu(kind[:, None] != kind[None, :])
        found = apart & (plain >= least)
        # the probability similarity is at most the part of either text that lies in common shingles
        could = apart & ~found & (heavy[:, None] | heavy[None, :]) & (np.minimum(mass, mass.T) >= least - 1e-4)
        for i, j in np.argwhere(could).tolist():
            found[i, j] = similarity(sets[i], sets[j]) >= least
        return [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(found).tolist()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, out = None, [], []
        for batch in batches:
            for key in zip(*[batch.column(c).to_pylist() for c in ("_band", "_i", "_j", "_id", "_class", "_text")], strict=True):
                if key[:3] != group:
                    out += links(members) if members else []
                    group, members = key[:3], []
                members.append(key[3:])
        out += links(members) if members else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["_a", "_b"])

    return rows


def components(links: DataFrame) -> DataFrame:
    """(_id, _class): the smallest id that each linked id is linked with, directly or not.

    Each round takes the smallest class among neighbours, then follows classes of classes until nothing changes; the lengths
    of chains halve, so rounds grow with the logarithm of the longest chain.
    """
    both = links.select(F.col("_a").alias("_id"), F.col("_b").alias("_to")).unionByName(links.select(F.col("_b").alias("_id"), F.col("_a").alias("_to")))
    both = cut_lineage(both.where("_id != _to").distinct(), "links")
    label = cut_lineage(both.groupBy("_id").agg(F.min("_to").alias("_to")).select("_id", F.least("_id", "_to").alias("_class")), "classes")
    while True:
        near = both.join(label.select(F.col("_id").alias("_to"), F.col("_class").alias("_c")), "_to").select("_id", "_c", F.lit(None).cast("long").alias("_old"))
        step = near.unionByName(label.select("_id", F.col("_class").alias("_c"), F.col("_class").alias("_old")))
        step = step.groupBy("_id").agg(F.min("_c").alias("_class"), F.max("_old").alias("_old"))
        up = label.select(F.col("_id").alias("_class"), F.col("_class").alias("_up"))
        step = cut_lineage(step.join(up, "_class", "left").select("_id", "_old", F.coalesce("_up", "_class").alias("_class")), "classes")
        label = step.select("_id", "_class")
        if step.where("_old != _class").isEmpty():
            return label


def _differing(a: str, b: str, words: int) -> Column:
    """Places in which two sketches differ, by the two-bit fields of their words."""

    def one(k: int) -> Column:
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    total = one(0)
    for k in range(1, words):
        total = total + one(k)
    return total


def classes(df: DataFrame, text: str = "text", size: int = 5, least: float = 0.8, bands: int = 32, rows: int = 5, registers: int = 160, leaders: int = 3, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(df with _k1, _k2; (_k1, _k2, _class) of the texts that have near-duplicates)."""
    texts = distinct_texts(df, text)
    words = registers // 32
    differ = (1 - least) * 0.75
    apart = int(registers * differ + 5 * (registers * differ * (1 - differ)) ** 0.5)
    sketches = [f"{s}{k}" for s in "sp" for k in range(words)]
    banded = texts.select("_k1", "_k2", "_text").mapInArrow(_band_rows(size, bands, rows, registers), f"_k1 long, _k2 int, _bands array<long>, {', '.join(f'_{x} long' for x in sketches)}")
    banded = cut_lineage(banded.withColumn("_id", F.monotonically_increasing_id()), "bands")
    group = banded.select("_id", F.explode("_bands").alias("_band"))
    shared = group.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1")
    group = cut_lineage(group.join(shared, "_band"), "band-groups")
    # the text with most company over all bands is closest to the middle of its group; ids decide ties
    middle = group.groupBy("_id").agg(F.sum("_n").alias("_score"))
    ranked = group.join(middle, "_id").select("_band", F.struct((-F.col("_score")).alias("order"), F.col("_id").alias("id")).alias("_x"), F.struct(F.xxhash64("_id").alias("order"), F.col("_id").alias("id")).alias("_y"))
    heads = ranked.groupBy("_band").agg(F.min("_x").alias("_x"), F.min("_y").alias("_y"))

    def known(side: str) -> DataFrame:
        """Ids with their sketches and the keys of their texts."""
        return banded.select(F.col("_id").alias(f"_{side}"), *[F.col(f"_{x}").alias(f"_{side}{x}") for x in sketches], *[F.col(k).alias(f"{k}{side}") for k in ("_k1", "_k2")])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are links. The texts of _b are read where they lie; _a may stand in very many pairs, and a shuffled
        join can split these."""
        pairs = cut_lineage(pairs.select("_a", "_b", "_k1a", "_k2a", "_k1b", "_k2b").distinct(), "pairs")

        def side(x: str) -> DataFrame:
            return texts.select(F.col("_k1").alias(f"_k1{x}"), F.col("_k2").alias(f"_k2{x}"), F.col("_text").alias(f"_t{x}"))

        heads = pairs.select("_a", "_k1a", "_k2a").distinct().join(side("a"), ["_k1a", "_k2a"]).select("_a", "_ta")
        found = pairs.join(side("b"), ["_k1b", "_k2b"]).select("_a", "_b", "_tb").join(heads, "_a")
        return cut_lineage(found.select("_a", "_b", "_ta", "_tb").mapInArrow(_check_rows(size, least), "_a long, _b long"), "links")

    # a text has two leaders a band at most, one by company and one by chance
    firsts = group.join(heads, "_band").groupBy("_id").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("_x", "_y")])
    chosen = F.concat(*[F.slice(F.filter(c, lambda x: x["id"] != F.col("_id")), 1, leaders) for c in ("_x", "_y")])
    pairs = firsts.select(F.explode(F.array_distinct(F.transform(chosen, lambda x: x["id"]))).alias("_a"), F.col("_id").alias("_b"))
    pairs = pairs.join(known("a"), "_a").join(known("b"), "_b").where((_differing("_as", "_bs", words) <= apart) | (_differing("_ap", "_bp", words) <= apart))
    links = verified(pairs)
    label = components(links)
    members = group.join(label, "_id", "left").withColumn("_class", F.coalesce("_class", "_id"))
    several = members.groupBy("_band").agg(F.min("_class").alias("_x"), F.max("_class").alias("_y")).where("_x != _y").select("_band")
    left = cut_lineage(members.join(several, "_band").join(banded.select("_id", "_k1", "_k2"), "_id"), "open-groups")
    # every two blocks of a large group meet once
    blocks = F.ceil(F.col("_n") / block)
    own = F.pmod(F.xxhash64("_id"), blocks)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(x, own).alias("_i"), F.greatest(x, own).alias("_j")))
    left = left.select("_band", "_id", "_class", "_k1", "_k2", F.explode(meet).alias("_meet")).select("*", "_meet._i", "_meet._j").drop("_meet")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_band", "_i", "_j"]
    left = left.join(texts.select("_k1", "_k2", "_text"), ["_k1", "_k2"]).select(*keys, "_id", "_class", "_text").repartition(n, *keys).sortWithinPartitions(*keys)
    more = cut_lineage(left.mapInArrow(_group_rows(size, least), "_a long, _b long").distinct(), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    return with_key(df, text), label.join(banded.select("_id", "_k1", "_k2"), "_id").select("_k1", "_k2", "_class")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with class_id, the smallest id of the near-duplicate class of each row (its own if it is alone)."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("class_id", "_k1", "_k2", "_class")])
    keyed, found = classes(df, text, **options)
    # a text without a near-duplicate is a class of its equals
    own = keyed.groupBy("_k1", "_k2").agg(F.min(id_column).alias("_low"))
    own = own.join(found, ["_k1", "_k2"], "left")
    low = own.where("_class is not null").groupBy("_class").agg(F.min("_low").alias("_least"))
    named = own.join(low, "_class", "left").select("_k1", "_k2", F.coalesce("_least", "_low").alias("class_id"))
    return keyed.join(named, ["_k1", "_k2"]).drop("_k1", "_k2")


def keep_first(df: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of df for each near-duplicate class: that with the smallest id, null ids last; of repeated rows one."""
    columns = df.columns
    keyed, found = classes(df, text, **options)
    rank = F.struct(F.col(id_column).isNull().alias("a"), F.col(id_column).alias("b"), F.col("_k1").alias("c"), F.col("_k2").alias("d"))
    own = keyed.groupBy("_k1", "_k2").agg(F.min(rank).alias("_low")).join(found, ["_k1", "_k2"], "left")
    low = own.where("_class is not null").groupBy("_class").agg(F.min("_low").alias("_least"))
    first = own.join(low, "_class", "left").where("_least is null or _least = _low").select("_k1", "_k2", F.col("_low.b").alias("_keep"))
    # a class keeps one text, and all rows with it meet in one partition
    kept = keyed.join(first, ["_k1", "_k2"]).where(F.col(id_column).eqNullSafe(F.col("_keep")))
    return kept.dropDuplicates(["_k1", "_k2"]).select(*columns)
