"""Language-model scores of whole texts: exact token counts and a recurrent model, both learnt from the training rows.

1. Rows are dealt into shards of about shard_bytes by a hash of id and text, as a table bucketed by shard.
2. Each shard sends its sorted distinct words with their training counts, cut by ranges of the word hash, of which there is one for each
   range_bytes of text; a shard has no record for a range without its words. A range adds up the
   counts of all shards and answers each shard with the totals of its words. The most frequent words of all ranges make the
   vocabulary of the recurrent model, as many as the square root of the training tokens and at least `words`; the counts have no
   limit.
3. Rounds: every shard trains the model on its part of the training rows (each row in one round) by truncated backpropagation, from
   the same start; the results are averaged in a tree of bounded fan-in.
4. Each shard scores its rows, whole texts, with the state carried from window to window.

The model gives a word outside its vocabulary P(rare | state) * (c + 1) / (rest of the tokens + rest of the words + 1), so
unseen words share one count. Words are told apart by 64-bit hashes.

A null or empty text is one end token; rows without an id count as training rows; no training rows: all counts 0; repeated rows get equal
scores; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.llm.gru import ENDINGS, Model, arrange, arrange_evenly
from utterlake.session import bucketed, cut_lineage

_END = np.uint64(0xE2D0F7E37E57E2D1)
LANES, STEPS = 320, 16
TRAIN_LANES, WINDOWS = 512, 120
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Parameter sets that are added up at once.
FAN_IN = 32
#: Bytes of parameters that come to the driver at once.
AT_ONCE = 256 << 20


class Tokens:
    """Token hashes of the texts of a shard, each text's words and then the end."""

    def __init__(self, texts, endings: bool = False):
        hashes, counts, ends = [], [], []
        for _, _, data, offs in K.text_chunks(texts):
            data = _LOWER[data]
            w = K.Words(data, offs)
            at = w.offs + np.arange(len(w.offs))
            h = np.full(int(at[-1]), _END, np.uint64)
            own = np.ones(len(h), bool)
            own[at[1:] - 1] = False
            h[own] = w.hash
            hashes.append(h)
            counts.append(w.count + 1)
            if endings:
                # the last two bytes of each word
                e = np.zeros(len(h), np.int64)
                e[own] = (data[w.end - 1].astype(np.int64) * 31 + data[np.maximum(w.end - 2, w.start)].astype(np.int64) * 257) % ENDINGS
                ends.append(e)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.offs = np.concatenate(([0], np.cumsum(self.count)))
        self.ending = np.concatenate(ends) if ends else None


def _distinct(h: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and their counts (sums of weights)."""
    if weight is None:
        h = np.sort(h)
        first = K.group_starts(h)
        return h[first], np.diff(np.append(first, len(h)))
    order = np.argsort(h)
    h = h[order]
    first = K.group_starts(h)
    return h[first], np.add.reduceat(weight[order], first) if len(h) else np.zeros(0, np.int64)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values, and the place of each value among them."""
    # a value's first bits and its place in one word: a sort of words is far faster than one of places
    bits = len(h).bit_length()
    order = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    order.sort()
    order = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
    every = h[order]
    if np.any(every[1:] < every[:-1]):
        # different values with the same first bits
        order = np.argsort(h)
        every = h[order]
    first = K.group_starts(every)
    place = np.empty(len(h), np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(h))))
    return every[first], place


def _shard_words(ranges: int):
    names = ["_range", "_shard", "_hashes", "_counts"]

    def count(table: pa.Table) -> pa.Table:
        held = table.column("held_out").to_numpy()
        t = Tokens(table.column("_text"))
        every, _ = _distinct(t.hash)
        seen, n = _distinct(t.hash[np.repeat(~held, t.count)])
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, seen)] = n
        step = (1 << 64) // ranges + 1
        cut = np.append(np.searchsorted(every, np.array([k * step for k in range(ranges)], np.uint64)), len(every))
        shard = table.column("_shard")[0].as_py()
        out = [(k, shard, every[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return count


def _range_totals(words: int):
    names = ["_range", "_shard", "_totals", "_words", "_tokens", "_top", "_top_counts"]

    def add(table: pa.Table) -> pa.Table:
        blobs = [[np.frombuffer(b, kind) for b in table.column(c).to_pylist()] for c, kind in (("_hashes", np.uint64), ("_counts", np.uint32))]
        every, total = _distinct(np.concatenate(blobs[0]), np.concatenate(blobs[1]).astype(np.int64))
        which = table.column("_range")[0].as_py()
        seen = total > 0
        order = np.lexsort((every, -total))[:words]
        order = order[total[order] > 0]
        shards = table.column("_shard").to_pylist()
        totals = [total[np.searchsorted(every, h)].astype(np.int64).tobytes() for h in blobs[0]]
        rows = [(which, s, t, None, None, None, None) for s, t in zip(shards, totals, strict=True)]
        rows.append((which, None, None, int(seen.sum()), int(total.sum()), every[order].view(np.int64).tolist(), total[order].tolist()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return add


class Lexicon:
    """The model's vocabulary: sorted hashes with their numbers, by frequency."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it is not in the vocabulary."""
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.number[at], -1)


def _coded(target: np.ndarray, model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of each token: the token before it and its number, -1 outside the vocabulary."""
    own = np.where(target >= 0, target, model.words + t.ending)
    inputs = np.empty(len(own), np.int64)
    inputs[1:] = own[:-1]
    inputs[t.offs[:-1]] = model.start
    return inputs, target


def _train(lexicon: Lexicon, hidden: int, blob: bytes, rate: float):
    def run(table: pa.Table) -> pa.Table:
        model = Model(len(lexicon.sorted), hidden).unpack(blob)
        t = Tokens(table.column("_text"), endings=True)
        inputs, target = _coded(lexicon.numbers(t.hash), model, t)
        # at least WINDOWS steps of learning, if there are tokens for them
        lanes = min(TRAIN_LANES, max(16, len(inputs) // (STEPS * WINDOWS)))
        grid, fresh, live, place = arrange_evenly(t.offs, inputs, lanes)
        goal = np.full(grid.size, -1)
        goal[place] = target
        goal = goal.reshape(grid.shape)
        state = np.zeros((lanes, hidden), np.float32)
        adam: dict = {}
        windows = range(0, len(grid), STEPS)
        for k, a in enumerate(windows):
            b = slice(a, a + STEPS)
            state = model.learn(grid[b], fresh[b], goal[b], live[b], state, adam, rate * (1 - 0.9 * k / len(windows)))
        return pa.table({"_params": pa.array([model.pack()], pa.binary()), "_weight": pa.array([float(len(t.hash))])})

    return run


def _add_params(batches):
    total, weight = None, 0.0
    for batch in batches:
        for blob, w in zip(batch.column("_params").to_pylist(), batch.column("_weight").to_pylist(), strict=True):
            x = np.frombuffer(blob, np.float32).astype(np.float64) * w
            total, weight = x if total is None else total + x, weight + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], names=["_params", "_weight"])


def _average(results: DataFrame, sets: int, nbytes: int) -> bytes | None:
    """The weighted mean of parameter sets of nbytes; each step of the tree adds up FAN_IN at a time (fewer if they are large), and
    the driver gets as many at most."""
    results = cut_lineage(results, "parameters")
    fan_in = max(2, min(FAN_IN, AT_ONCE // nbytes))
    while sets > fan_in:
        sets = -(-sets // fan_in)
        results = cut_lineage(results.repartition(sets).mapInArrow(_add_params, "_params binary, _weight double"), "parameters")
    rows = [(r._params, r._weight) for r in results.collect()]
    if not rows:
        return None
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], names=["_params", "_weight"])
    return next(iter(_add_params([batch]))).column("_params")[0].as_py()


def _score(lexicon: Lexicon, hidden: int, blob: bytes, n: int, v: int, top_n: int, id_type: pa.DataType):
    words = len(lexicon.sorted)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.Table.from_arrays([pa.array([], k) for k in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        model = Model(words, hidden).unpack(blob)
        t = Tokens(rows.column("_text"), endings=True)
        every, place_of = _numbered(t.hash)
        parts = sorted(zip(answers.column("_range").to_pylist(), answers.column("_totals").to_pylist(), strict=True))
        total = np.concatenate([np.frombuffer(b, np.int64) for _, b in parts])
        # looked up and worked out once for each different word
        number = lexicon.numbers(every)
        base = np.log10((total + 1) / (n + (v + 1)))[place_of]
        rare = np.where(number < 0, np.log10((total + 1) / ((n - top_n) + (v - words) + 1)), 0.0)
        inputs, target = _coded(number[place_of], model, t)
        grid, fresh, live, place, reach = arrange(t.count, t.offs, inputs, LANES)
        goal = np.full(grid.size, -1)
        goal[place] = target
        goal = goal.reshape(grid.shape)
        flat = np.zeros(grid.size)
        state = np.zeros((grid.shape[1], hidden), np.float32)
        step, table = 4 * STEPS, model.table()
        flat = flat.reshape(grid.shape)
        for a in range(0, len(grid), step):
            b = slice(a, a + step), slice(0, reach[a])
            h, state, _, _ = model.recur(grid[b], fresh[b], state[: reach[a]], table)
            some = np.flatnonzero(live[b])
            got = np.zeros(h.shape[:2])
            got.ravel()[some] = model.log_probs(h.reshape(-1, hidden).take(some, 0), goal[b].ravel()[some])[0]
            flat[b] = got
        flat = flat.ravel()
        own = flat[place] / math.log(10)
        own += rare[place_of]

        def sums(x):
            return np.add.reduceat(x, t.offs[:-1])

        m = len(t.count)
        return pa.Table.from_arrays(
            [rows.column("doc_id"), rows.column("held_out"), pa.array(t.count), pa.array(sums((total > 0).astype(np.int64)[place_of])), pa.array(np.full(m, n)), pa.array(sums(base)), pa.array(sums(own))],
            names=names,
        )

    return run


def score_texts(
    df: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text: str = "text",
    words: int = 2048,
    hidden: int = 16,
    rounds: int = 2,
    rate: float = 0.02,
    shard_bytes: int = 12 << 20,
    range_bytes: int = 64 << 20,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; learns where held_out is false."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # equal rows are spread, too
    h = F.xxhash64("doc_id", "_text", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    rows = rows.withColumns({"_shard": F.pmod(h, F.lit(shards)).cast("int"), "_round": F.pmod(F.xxhash64(F.lit(5), h), F.lit(rounds)).cast("int")})
    table = bucketed(rows.repartition(shards, "_shard"), shards, ["_shard"], "shards")

    counted = table.select("_shard", "held_out", "_text").groupBy("_shard").applyInArrow(_shard_words(max(1, -(-total // range_bytes))), "_range int, _shard int, _hashes binary, _counts binary")
    totals = counted.groupBy("_range").applyInArrow(
        _range_totals(max(words, math.isqrt(total))), "_range int, _shard int, _totals binary, _words long, _tokens long, _top array<long>, _top_counts array<long>"
    )
    totals = cut_lineage(totals, "totals")
    stats = totals.where("_shard is null")
    v, n = stats.agg(F.coalesce(F.sum("_words"), F.lit(0)), F.coalesce(F.sum("_tokens"), F.lit(0))).first()
    pairs = stats.select(F.explode(F.arrays_zip("_top", "_top_counts")).alias("t")).select("t._top", "t._top_counts")
    # there are fewer tokens than bytes, so the ranges have sent enough words
    words = max(words, math.isqrt(n))
    top = pairs.orderBy(F.desc("_top_counts"), "_top").limit(words).collect()
    counts = np.array([r[1] for r in top], np.int64)
    lexicon = Lexicon(np.array([r[0] for r in top], np.int64).view(np.uint64))
    top_n = int(counts.sum())
    blob = Model(len(top), hidden, counts=counts, rest=float(n - top_n)).pack()
    for k in range(rounds if len(top) else 0):
        part = table.where(f"not held_out and _round = {k}").select("_shard", "_text")
        results = part.groupBy("_shard").applyInArrow(_train(lexicon, hidden, blob, rate / (k + 1)), "_params binary, _weight double")
        blob = _average(results, shards, len(blob)) or blob
    answers = totals.where("_shard is not null").select("_shard", "_range", "_totals")
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_type

    run = _score(lexicon, hidden, blob, n, v, top_n, to_arrow_type(df.schema[id_column].dataType))
    both = table.select("doc_id", "held_out", "_text", "_shard").groupBy("_shard").cogroup(answers.groupBy("_shard"))
    return both.applyInArrow(run, schema)
