"""Repeated windows of whole texts: the frame that both substring operators run their method in.

A window is `length` consecutive symbols (bytes, words) of one text; it is repeated if the same symbols start anywhere
else, in the same text or another. Equal texts are folded into one row with their number first.

1. Each window is filed under the smallest hash among its `gram`-symbol parts (its anchor). Neighbouring windows with one
   anchor form a run; equal windows have equal anchors. Runs go out as ids and numbers only, and an anchor that occurs
   once can't belong to a repeated window, so most text ends here.
2. The symbols of the runs that are left (pieces) are dealt into blocks by anchor: all pieces that may share a window are
   in one block. Each task sends a piece's symbols once. A block is decided by the method of the operator.
3. An anchor with more than `hot` runs would make one block too large. Its pieces are dealt by their contents, each block
   is decided alone, and the sorted window digests of these blocks are merged by binary search, range by range.
4. The repeated windows go back to the texts, where they become spans.

Memory holds a block, one range of merged digests or the pieces of one task's texts, whichever is largest; nothing is
capped and nothing reaches the driver but a row count. Intermediate frames are files in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.session import bucketed, cut_lineage

#: Symbols in a block, about.
BLOCK = 1 << 20
#: Windows in one range of merged digests, about.
RANGE = 1 << 21
_POS = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Method:
    """What differs between the operators."""

    words: bool
    length: int
    gram: int
    #: (pieces as symbol arrays, window length) -> longest match elsewhere in the block is long enough, per window
    repeated: Callable[[list[np.ndarray], int], list[np.ndarray]]
    hot: int = 4000


class Symbols:
    """The symbols of a chunk of texts."""

    def __init__(self, words: bool, data: np.ndarray, offs: np.ndarray):
        self.words = words
        if words:
            w = self.table = K.Words(data, offs)
            self.values, self.offs = w.hash, w.offs
        else:
            self.values, self.offs = data, offs

    def codes(self) -> np.ndarray:
        """Codes to hash the symbols by."""
        return self.values if self.words else K.BYTE_CODE[self.values]


def window_runs(codes: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(text, first window, windows, anchor hash) of each run of windows that share an anchor."""
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    m = n - length + 1
    sums = K.prefix_hash(codes)
    g = K.part_hash(sums, slice(0, n - gram + 1), slice(gram, n + 1))
    if n > int(_POS):
        # positions no longer fit beside the hash: the order of anchors is the hash alone, the first of equals wins
        spot = _leftmost(g, length - gram + 1)
    else:
        spot = (K.sliding_min((g & ~_POS) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & _POS).astype(np.int64)
    texts = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:m]
    ok = np.arange(m) + length <= offs[texts + 1]
    new = ok.copy()
    new[1:] &= (spot[1:] != spot[:-1]) | (texts[1:] != texts[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    # a run ends where the next begins or where the text has no window left
    stop = np.minimum(np.append(first[1:], m), offs[texts[first] + 1] - length + 1)
    return texts[first], first - offs[texts[first]], stop - first, g[spot[first]].view(np.int64)


def _leftmost(g: np.ndarray, w: int) -> np.ndarray:
    """First position of the minimum of each w neighbours, by the upper bits as in the packed form."""
    top, n = g & ~_POS, len(g) - w + 1
    out, step = np.empty(n, np.int64), int(_POS) // 2
    for a in range(0, n, step):
        part = top[a : min(n, a + step) + w - 1]
        out[a : a + step] = a + (K.sliding_min(part | np.arange(len(part), dtype=np.uint64), w) & _POS).astype(np.int64)
    return out


def with_key(df: DataFrame, text: str) -> DataFrame:
    """Add the 96-bit key of the text; a null is an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_k1": F.xxhash64(t), "_k2": F.hash(F.lit(7), t, F.xxhash64(F.lit(11), t))})


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """(_k1, _k2, _text, _many) of each different text, as a table bucketed by key so that later joins don't move it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_key(df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    one = keyed.groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"), (F.count("*") > 1).alias("_many"))
    return bucketed(one, n, ["_k1", "_k2"], "texts")


def _anchor_rows(method: Method):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("_k1").to_numpy(), batch.column("_k2").to_numpy()
            for i, _, data, offs in K.text_chunks(batch.column("_text")):
                s = Symbols(method.words, data, offs)
                text, first, n, h = window_runs(s.codes(), s.offs, method.length, method.gram)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(k1[i + text]), pa.array(k2[i + text]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                        names=["_h", "_k1", "_k2", "_first", "_n"],
                    )

    return rows


_PIECE = "_shard long, _hot boolean, _p1 long, _p2 long, _k1 long, _k2 int, _first int, _n int, _body binary"


def _piece_rows(method: Method):
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            k1, k2 = batch.column("_k1").to_numpy(), batch.column("_k2").to_numpy()
            many = batch.column("_many").to_numpy(zero_copy_only=False)
            lists = batch.column("_runs")
            at, item = lists.offsets.to_numpy(), lists.values
            firsts, ns, hs, hots = (item.field(c).to_numpy(zero_copy_only=False) for c in ("_first", "_n", "_h", "_hot"))
            for i, j, data, offs in K.text_chunks(batch.column("_text")):
                s = Symbols(method.words, data, offs)
                sl = slice(at[i], at[j])
                text = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                begin = s.offs[text - i] + firsts[sl]
                end = begin + ns[sl] + method.length - 1
                p1 = K.span_hash(s.values, begin, end, 1).view(np.int64)
                p2 = K.span_hash(s.values, begin, end, 2).view(np.int64)
                hot = hots[sl]
                shard = np.where(hot, p2, hs[sl])
                bodies: list[bytes | None] = []
                for a, b, x, y, m in zip(begin.tolist(), end.tolist(), p1.tolist(), p2.tolist(), many[text].tolist(), strict=True):
                    count = seen.get((x, y), 0)
                    bodies.append(s.values[a:b].tobytes() if count == 0 else b"" if count == 1 else None)
                    seen[x, y] = count + 1 + (m and count == 0)
                    if m and count == 0:
                        bodies[-1] += b"*"  # stands for a text of which there are copies
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (shard, hot, p1, p2, k1[text], k2[text], firsts[sl], ns[sl])] + [pa.array(bodies, pa.binary())],
                    names=names,
                )

    return rows


_FOUND = "_p1 long, _p2 long, _runs binary, _range int, _digests binary"


def _runs_of(flags: np.ndarray) -> bytes:
    """(first, length) of each run of true flags, as 32-bit numbers."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return np.stack((edge[::2], edge[1::2] - edge[::2]), 1).astype(np.int32).tobytes()


def _block_rows(method: Method, n_ranges: int):
    """Decide each block; shards come sorted, and a block ends where the shard changes."""
    kind = np.dtype(np.uint64 if method.words else np.uint8)
    record = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("p1", "<i8"), ("p2", "<i8"), ("at", "<i4")])

    def decide(pieces: dict) -> Iterator[tuple]:
        keys = list(pieces)
        bodies = [np.frombuffer(pieces[k][0], kind) for k in keys]
        found = method.repeated(bodies, method.length)
        digests = []
        for key, body, flags in zip(keys, bodies, found, strict=True):
            if pieces[key][1] > 1:
                flags = np.ones(len(body) - method.length + 1, bool)
            if flags.any():
                yield (*key, _runs_of(flags), None, None)
            if pieces[key][2]:
                n = len(body) - method.length + 1
                codes, codes_2 = (body, K.mix(body)) if method.words else (K.BYTE_CODE[body], K.BYTE_CODE_2[body])
                part = np.empty(n, record)
                for name, c in (("d1", codes), ("d2", codes_2)):
                    part[name] = K.part_hash(K.prefix_hash(c), np.arange(n), np.arange(n) + method.length)
                part["p1"], part["p2"], part["at"] = *key, np.arange(n)
                digests.append(part)
        if digests:
            all_ = np.concatenate(digests)
            all_ = all_[np.argsort(all_["d1"], kind="stable")]
            step = (1 << 64) // n_ranges + 1
            cut = np.searchsorted(all_["d1"], np.array([k * step for k in range(n_ranges)] , np.uint64))
            for k, (a, b) in enumerate(zip(cut, np.append(cut[1:], len(all_)), strict=True)):
                if b > a:
                    yield (None, None, None, k, all_[a:b].tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple[int, int], list] = {}
        size, shard = 0, None

        def flush():
            if pieces:
                out = list(decide(pieces))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(("_p1", "_p2", "_runs", "_range", "_digests"), r, strict=True)) for r in out], schema=schema)

        schema = pa.schema([("_p1", pa.int64()), ("_p2", pa.int64()), ("_runs", pa.binary()), ("_range", pa.int32()), ("_digests", pa.binary())])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("_shard", "_hot", "_p1", "_p2", "_n", "_body")]
            for sh, hot, p1, p2, n, body in zip(*cols, strict=True):
                if sh != shard and size >= BLOCK:
                    yield from flush()
                    pieces, size = {}, 0
                shard = sh
                full = (n + method.length - 1) * kind.itemsize
                have = pieces.get((p1, p2))
                if have is None:
                    # a marker can come before its piece; the length tells them apart
                    have = pieces[p1, p2] = [b"", 0, hot]
                extra = len(body) % kind.itemsize if method.words else len(body) not in (0, full)
                if len(body) >= full and not have[0]:
                    have[0] = body[:full]
                    size += n + method.length
                have[1] += 2 if extra else 1
        yield from flush()

    return rows


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Find windows that several blocks hold: each block's sorted digests are searched in the others', range by range."""
    record = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("p1", "<i8"), ("p2", "<i8"), ("at", "<i4")])

    def merge(runs: list[np.ndarray]) -> pa.RecordBatch:
        hits = [np.zeros(len(r), bool) for r in runs]
        every = np.concatenate(runs)
        order = np.lexsort((every["d2"], every["d1"]))
        d1, d2 = every["d1"][order], every["d2"][order]
        for r, hit in zip(runs, hits, strict=True):
            lo, hi = np.searchsorted(d1, r["d1"], "left"), np.searchsorted(d1, r["d1"], "right")
            for k in np.flatnonzero(hi - lo > 1):
                a, b = np.searchsorted(d2[lo[k] : hi[k]], r["d2"][k], "left"), np.searchsorted(d2[lo[k] : hi[k]], r["d2"][k], "right")
                hit[k] = b - a > 1
        got = np.concatenate([r[h] for r, h in zip(runs, hits, strict=True)])
        got = got[np.lexsort((got["at"], got["p2"], got["p1"]))]
        # one row for each piece, whatever the number of its windows
        same = (got["p1"][1:] == got["p1"][:-1]) & (got["p2"][1:] == got["p2"][:-1])
        first = np.flatnonzero(np.concatenate(([True], ~same))) if len(got) else np.zeros(0, np.int64)
        pairs = np.stack((got["at"], np.ones(len(got), np.int32)), 1).astype(np.int32)
        blobs = [pairs[x:y].tobytes() for x, y in zip(first.tolist(), [*first[1:].tolist(), len(got)], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(got["p1"][first]), pa.array(got["p2"][first]), pa.array(blobs, pa.binary())], names=["_p1", "_p2", "_runs"])

    runs: list[np.ndarray] = []
    which = None
    for batch in batches:
        for k, blob in zip(batch.column("_range").to_pylist(), batch.column("_digests").to_pylist(), strict=True):
            if k != which and runs:
                yield merge(runs)
                runs = []
            which = k
            runs.append(np.frombuffer(blob, record))
    if runs:
        yield merge(runs)


def repeated_runs(texts: DataFrame, method: Method) -> DataFrame:
    """(_k1, _k2, _spans) of each text with repeated windows; _spans: (first window, runs of repeated windows) pairs."""
    spark = texts.sparkSession
    anchors = texts.select("_k1", "_k2", "_text").mapInArrow(_anchor_rows(method), "_h long, _k1 long, _k2 int, _first int, _n int")
    anchors = cut_lineage(anchors, "anchors")
    counts = anchors.groupBy("_h").agg(F.count("*").alias("_c")).where("_c > 1")
    counts = cut_lineage(counts, "anchor-counts")
    # copies of a text are one row here, yet their windows are repeated: known from _many, and they serve as matches
    hot_runs = counts.where(F.col("_c") > method.hot).agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    n_ranges = max(1, -(-hot_runs * method.length // (2 * RANGE)))
    runs = (
        anchors.join(counts, "_h")
        .select("_k1", "_k2", F.struct("_first", "_n", "_h", (F.col("_c") > method.hot).alias("_hot")).alias("_run"))
        .groupBy("_k1", "_k2")
        .agg(F.collect_list("_run").alias("_runs"))
    )
    pieces = texts.join(runs, ["_k1", "_k2"]).select("_k1", "_k2", "_text", "_many", "_runs").mapInArrow(_piece_rows(method), _PIECE)
    pieces = cut_lineage(pieces, "pieces")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pieces.where("_body is not null").select("_shard", "_hot", "_p1", "_p2", "_n", "_body").repartition(n, "_shard").sortWithinPartitions("_shard")
    found = blocks.mapInArrow(_block_rows(method, n_ranges), _FOUND)
    if hot_runs:
        found = cut_lineage(found, "blocks")
        merged = found.where("_range is not null").select("_range", "_digests").repartition(n, "_range").sortWithinPartitions("_range")
        merged = merged.mapInArrow(_merge_rows, "_p1 long, _p2 long, _runs binary")
        merged = merged.groupBy("_p1", "_p2").agg(F.collect_list("_runs").alias("_all")).select("_p1", "_p2", F.concat_ws("", F.transform("_all", F.hex)).alias("_hex"))
        merged = merged.select("_p1", "_p2", F.unhex("_hex").alias("_runs"))
        found = found.where("_runs is not null").select("_p1", "_p2", "_runs").unionByName(merged)
    else:
        found = found.select("_p1", "_p2", "_runs")
    return (
        pieces.select("_p1", "_p2", "_k1", "_k2", "_first")
        .join(found, ["_p1", "_p2"])
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("_first", "_runs")).alias("_spans"))
    )


def _gone(method: Method, s: Symbols, many: np.ndarray, docs: np.ndarray, firsts: np.ndarray, blobs) -> np.ndarray:
    """Which symbols of a chunk lie in a repeated window. docs, firsts, blobs: the runs, by text of the chunk."""
    data, at = K.buffers(blobs)
    pairs = data.view(np.int32).reshape(-1, 2) if data.flags.c_contiguous and len(data) else np.frombuffer(data.tobytes(), np.int32).reshape(-1, 2)
    count = np.diff(at) // 8
    a = np.repeat(s.offs[docs] + firsts, count) + pairs[:, 0]
    b = a + pairs[:, 1] + method.length - 1
    full = np.flatnonzero(many & (np.diff(s.offs) >= method.length))
    a, b = np.concatenate((a, s.offs[full])), np.concatenate((b, s.offs[full + 1]))
    n = int(s.offs[-1])
    return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0


def _kept_words(w: K.Words, data: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words joined by single spaces, as bytes of the chunk and offsets of the texts."""
    keep = np.flatnonzero(~gone)
    n = len(data)
    mark = np.bincount(w.start[keep], minlength=n + 1) - np.bincount(w.end[keep], minlength=n + 1)
    mask = np.cumsum(mark)[:n] > 0
    # white space follows each word that has another one after it
    joint = w.end[keep[:-1][w.doc[keep[1:]] == w.doc[keep[:-1]]]]
    mask[joint] = True
    data = data.copy()
    data[joint] = 32
    return data[mask], np.concatenate(([0], np.cumsum(mask)))[offs]


def _whole_characters(data: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left as text: a character of which only a part is removed stays whole."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, lead) if len(lead) else np.zeros(0, bool)
    mask = ~np.repeat(whole, np.diff(np.append(lead, len(data))))
    return data[mask], np.concatenate(([0], np.cumsum(mask)))[offs]


def _cut_rows(method: Method, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column("_many").to_numpy(zero_copy_only=False)
            lists = batch.column("_spans")
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            item = lists.flatten()
            firsts = item.field("_first").to_numpy(zero_copy_only=False) if len(item) else np.zeros(0, np.int64)
            for i, j, data, offs in K.text_chunks(batch.column("_text")):
                s = Symbols(method.words, data, offs)
                own = slice(int(at[i]), int(at[j]))
                docs = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                blobs = item.field("_runs").slice(own.start, own.stop - own.start) if len(item) else pa.array([], pa.binary())
                gone = _gone(method, s, many[i:j], docs, firsts[own], blobs)
                up, down = gone.copy(), gone.copy()
                up[1:] &= ~gone[:-1]
                down[:-1] &= ~gone[1:]
                starts, ends = s.offs[:-1][np.diff(s.offs) > 0], s.offs[1:][np.diff(s.offs) > 0] - 1
                up[starts], down[ends] = gone[starts], gone[ends]
                n_spans = K.sums_by(up, s.offs)
                edges = np.stack((np.flatnonzero(up), np.flatnonzero(down) + 1), 1) - np.repeat(s.offs[:-1], n_spans)[:, None]
                if method.words:
                    kept, cut = _kept_words(s.table, data, offs, gone)
                    text, text_cut = kept, cut
                else:
                    kept, cut = data[~gone], np.concatenate(([0], np.cumsum(~gone)))[s.offs]
                    text, text_cut = _whole_characters(data, offs, gone) if with_text else (None, None)
                view = memoryview(np.ascontiguousarray(kept))
                sums = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                if with_text:
                    texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(text_cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
                else:
                    texts = pa.nulls(j - i, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_k1").slice(i, j - i),
                        batch.column("_k2").slice(i, j - i),
                        pa.array(np.diff(s.offs).astype(np.int64)),
                        pa.array(K.sums_by(gone, s.offs)),
                        pa.array(n_spans),
                        pa.array(sums),
                        pa.ListArray.from_arrays(pa.array((np.concatenate(([0], np.cumsum(n_spans))) * 2).astype(np.int32)), pa.array(edges.ravel().astype(np.int64))),
                        texts,
                    ],
                    names=["_k1", "_k2", "n_symbols", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"],
                )

    return rows


def cut_texts(df: DataFrame, text: str, method: Method, with_text: bool) -> DataFrame:
    """One row for each row of df: its columns, then n_symbols, n_removed, n_spans, kept_sha256, spans, kept_text."""
    texts = distinct_texts(df, text)
    spans = repeated_runs(texts, method)
    done = texts.join(spans, ["_k1", "_k2"], "left").select("_k1", "_k2", "_text", "_many", "_spans")
    done = done.mapInArrow(
        _cut_rows(method, with_text),
        "_k1 long, _k2 int, n_symbols long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept_text string",
    )
    return with_key(df, text).join(done, ["_k1", "_k2"]).drop("_k1", "_k2")
