"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The vocabulary file gives pieces and their ranks; a piece's weight is 1 / (rank + 1) to the power `sharpness`. A text is cut before
each space that follows another character, as no piece reaches over such a place. For each unit the forward
probabilities of its piece lattice are summed once in a chunk; every occurrence then samples its own segmentation from the
end backwards, with draws that are a hash of the row's key, the place of the unit and the step. So a row is always cut alike,
whatever the partitions. Characters outside the vocabulary become byte pieces, a literal U+2581 too, so decoding is exact.

Null and empty texts have no pieces; a unit may be as long as its text; repeated rows with equal keys get equal pieces; an empty
table gives an empty table; columns that are added replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm import kernel as K

#: Bytes of text in a chunk: its lattice stays in the cache.
PART = 1 << 19
_SLOTS = 18
_SPACE, _LITERAL = 0x2581, 0x110001


class Vocabulary:
    """The pieces of a vocabulary file: bytes, weights and a hash table of their prefixes. Its size is that of the file."""

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        first = next(i for i in range(n) if model.is_byte(i))
        self.first_byte = first
        rank = np.minimum(np.maximum(-np.array([model.get_score(i) for i in range(n)]), 0), n)
        self.weight = -sharpness * np.log(rank + 1)
        blobs = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([i - first]) if model.is_byte(i) else names[i].replace("▁", " ").encode() for i in range(n)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_at = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
        self.longest = max(len(names[i]) for i in plain)
        keys: dict[int, int] = {}
        codes = np.array([ord(c) for i in plain for c in names[i]], np.uint64)
        lens = np.array([len(names[i]) for i in plain])
        at = np.concatenate(([0], np.cumsum(lens)))[:-1]
        sums = K.prefix_hash(K.mix(codes + np.uint64(1)))
        for size in range(1, self.longest + 1):
            some = np.flatnonzero(lens >= size)
            hashes = K.part_hash(sums, at[some], at[some] + size)
            for h, k in zip(hashes.tolist(), some.tolist(), strict=True):
                if lens[k] == size:
                    keys[h] = plain[k]
                else:
                    keys.setdefault(h, -1)
        self.slot_hash = np.zeros(1 << _SLOTS, np.uint64)
        self.slot_id = np.full(1 << _SLOTS, -2, np.int32)
        for h, i in keys.items():
            s = h >> (64 - _SLOTS)
            while self.slot_id[s] != -2:
                s = (s + 1) & ((1 << _SLOTS) - 1)
            self.slot_hash[s], self.slot_id[s] = h, i

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for a mere prefix of a piece, -2 for neither."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.slot_id[slot]
        miss = np.flatnonzero((out != -2) & (self.slot_hash[slot] != h))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << _SLOTS) - 1)
            out[miss] = self.slot_id[slot[miss]]
            miss = miss[(out[miss] != -2) & (self.slot_hash[slot[miss]] != h[miss])]
        return out


def _characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a space before each text that has any, and the offsets of the texts in them."""
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
    some = np.diff(lead) > 0
    at = lead + np.concatenate(([0], np.cumsum(some)))
    out = np.full(int(at[-1]), _SPACE, np.uint32)
    own = np.ones(len(out), bool)
    own[at[:-1][some]] = False
    cp = np.where(cp == _SPACE, _LITERAL, np.where(cp == 32, _SPACE, cp)).astype(np.uint32)
    out[own] = cp
    return out, at


class Lattice:
    """Forward probabilities of the piece lattices of units, given as ranges of one code point sequence."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lens = ends - starts
        cut = np.concatenate(([0], np.cumsum(lens)))
        chars = codes[K.ranges(starts, lens)]
        n = len(chars)
        unit_end = np.repeat(cut[1:], lens)
        sums = K.prefix_hash(K.mix(chars.astype(np.uint64) + np.uint64(1)))
        live, froms, tos, ids = np.arange(n), [], [], []
        known = np.zeros(n, bool)
        for size in range(1, v.longest + 1):
            live = live[live + size <= unit_end[live]]
            if not len(live):
                break
            got = v.look_up(K.part_hash(sums, live, live + size))
            hit = got >= 0
            if size == 1:
                known[live[hit]] = True
            froms.append(live[hit]), tos.append(live[hit] + size), ids.append(got[hit].astype(np.int64))
            live = live[got != -2]
        # a character outside the vocabulary is one edge that stands for its bytes: -1 - place among these characters
        odd = np.flatnonzero(~known)
        spelled = [_SPACE if c == _LITERAL else c for c in chars[odd].tolist()]
        self.spelled = [chr(c).encode() for c in spelled]
        froms.append(odd), tos.append(odd + 1), ids.append(-1 - np.arange(len(odd)))
        begin, to, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        weight = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], -30.0)
        # nodes: place in the unit first, so that one slice of edges ends at one place of all units
        unit = np.repeat(np.arange(len(lens)), lens)
        depth = np.arange(n) - cut[unit] + 1
        # a stable sort of 16-bit numbers is a radix sort; deeper places of very long units take a general one
        order = np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 1 << 15 else depth, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        node = rank[to - 1]
        # edges of a node by their lengths, so that their order hangs on the unit alone
        order = np.argsort(node * 64 + (to - begin))
        begin, piece, weight, node = begin[order], piece[order], weight[order], node[order]
        starts_unit = begin == cut[unit[begin]]
        before = np.where(starts_unit, -1, rank[np.maximum(begin - 1, 0)])
        first = K.group_starts(node)
        levels = np.cumsum(np.bincount(depth)[1:])
        forward = np.zeros(n + 1)  # the last is the start of every unit
        chance = np.empty(len(node))
        lo = 0
        for hi in levels.tolist():
            a, b = first[lo], first[hi] if hi < n else len(node)
            x = forward[before[a:b]] + weight[a:b]
            group = first[lo:hi] - a
            size = np.diff(np.append(group, b - a))
            top = np.maximum.reduceat(x, group)
            e = np.exp(x - np.repeat(top, size))
            total = np.add.reduceat(e, group)
            forward[lo:hi] = top + np.log(total)
            chance[a:b] = e / np.repeat(total, size)
            lo = hi
        # running chances of the edges of a node, from the number of the node on
        run = np.cumsum(chance)
        run -= np.repeat(np.append(0.0, run)[first], np.diff(np.append(first, len(node))))
        self.bound = node + np.minimum(run, 1.0)
        last = np.append(first[1:], len(node)) - 1
        self.bound[last] = node[last] + 1.0
        self.before, self.piece = before, piece
        self.end_node = rank[cut[1:] - 1]

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, edges of each occurrence) of a sampled segmentation of each occurrence of a unit."""
        live, node = np.arange(len(unit)), self.end_node[unit]
        count = np.zeros(len(unit), np.int64)
        steps = []
        while len(live):
            k = len(steps)
            u = (K.mix(key[live] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(12)).astype(np.float64) * 2.0**-52
            edge = np.searchsorted(self.bound, node + u, "right")
            steps.append((live, edge))
            count[live] += 1
            node = self.before[edge]
            go = node >= 0
            live, node = live[go], node[go]
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (who, edge) in enumerate(steps):
            out[end[who] - 1 - k] = edge
        return out, count


def encode_texts(v: Vocabulary, texts, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids of each text) chunk by chunk."""
    for i, j, data, offs in K.text_chunks(texts, PART):
        codes, at = _characters(data, offs)
        if not len(codes):
            yield np.zeros(0, np.int32), np.zeros(j - i, np.int64)
            continue
        space = codes == _SPACE
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(codes))
        doc = np.searchsorted(at, start, "right") - 1
        h = K.part_hash(K.prefix_hash(K.mix(codes.astype(np.uint64) + np.uint64(1))), start, end)
        order = np.argsort(h)
        lead = K.group_starts(h[order])
        unit = np.empty(len(h), np.int64)
        unit[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(h))))
        lattice = Lattice(v, codes, start[order[lead]], end[order[lead]])
        place = np.arange(len(start)) - np.searchsorted(doc, np.arange(j - i))[doc]
        edges, count = lattice.sample(unit, K.mix(keys[i:j][doc].view(np.uint64) + K.mix(place.astype(np.uint64) + np.uint64(1))))
        ids = lattice.piece[edges]
        of_unit = np.repeat(np.arange(len(start)), count)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            blobs = [lattice.spelled[k] for k in (-1 - ids[odd]).tolist()]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(b) for b in blobs]
            ids, of_unit = np.repeat(ids, size), np.repeat(of_unit, size)
            ids[ids < 0] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64) + v.first_byte
        yield ids.astype(np.int32), np.bincount(doc[of_unit], minlength=j - i)


def decode_ids(v: Vocabulary, pieces: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes that piece ids stand for, and the offsets of the texts in them."""
    a = v.blob_at[pieces]
    size = v.blob_at[pieces + 1] - a
    data = v.blob[K.ranges(a, size)]
    ends = np.concatenate(([0], np.cumsum(size)))[offs]
    # the space before a text goes
    some = np.diff(ends) > 0
    keep = np.ones(len(data), bool)
    keep[ends[:-1][some]] = False
    return data[keep], ends - np.concatenate(([0], np.cumsum(some)))


def _same(v: Vocabulary, texts, pieces: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text is what its pieces decode to."""
    want, want_at = K.buffers(texts)
    got, got_at = decode_ids(v, pieces, offs)
    if np.array_equal(want_at, got_at) and np.array_equal(want, got):
        return np.ones(len(texts), bool)
    return np.array([want[a:b].tobytes() == got[c:d].tobytes() for a, b, c, d in zip(want_at[:-1], want_at[1:], got_at[:-1], got_at[1:], strict=True)])


def encode(
    df: DataFrame, path: str, text: str = "text", key: str = "doc_id", seed: int = 2, sharpness: float = 1.0, name: str = "ids", verified: str | None = None
) -> DataFrame:
    """df with the sampled piece ids of its texts, an array of int; verified: a column that says whether they decode to the text."""
    v = df.sparkSession.sparkContext.broadcast(Vocabulary(path, sharpness))
    added = {name: "array<int>"} | ({verified: "boolean"} if verified else {})
    keep = [c for c in df.columns if c.lower() not in added]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                done = list(encode_texts(v.value, part.column("_text"), part.column("_key").to_numpy()))
                offs = np.concatenate(([0], np.cumsum(np.concatenate([c for _, c in done]))))
                ids = np.concatenate([x for x, _ in done])
                cols = [*[part.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids, pa.int32()))]
                if verified:
                    cols.append(pa.array(_same(v.value, part.column("_text"), ids, offs)))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in added.items()])
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.lit(seed), F.col(key)).alias("_key"))
    return given.mapInArrow(rows, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text that piece ids stand for."""
    v = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    keep = [c for c in df.columns if c.lower() != name]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                lists = part.column(ids)
                offs = lists.offsets.to_numpy()
                data, ends = decode_ids(v.value, lists.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(), offs - offs[0])
                text = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], text], names=[*keep, name])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{name} string"])
    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(rows, schema)
