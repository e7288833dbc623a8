"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics of every whole text are counted once. The trees are trained on a sample of labelled rows (about `train_rows` or
fewer, by a hash of their ids; the driver holds their statistics only) and flattened into node arrays, which every
task scores its rows with.

Null texts have no words and fail the base rules; null labels are left out; without labels of both kinds the base rules alone
decide; an empty table gives an empty table; repeated rows are judged alike. New columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.session import cut_lineage

#: The symbols of the contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Words in a window that counts as repeated.
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bytes", "n_letters")
#: Name and direction of each statistic the trees see: -1, more of it never raises the score.
FEATURES = (
    ("words", 0),
    ("word_length", 0),
    ("symbols", -1),
    ("dup_lines", -1),
    ("repeat_words", -1),
    ("upper", -1),
    ("digits", 0),
    ("marks", -1),
    ("line_words", 0),
)


def statistics(texts) -> np.ndarray:
    """COUNTS of each text of a string column."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for i, j, data, offs in K.text_chunks(texts):
        w = K.Words(data, offs)
        o = out[i:j]
        o[:, 0] = w.count
        o[:, 1] = K.sums_by(~K.SPACE[data] & ((data & 0xC0) != 0x80), offs)
        o[:, 2] = K.sums_by(SYMBOLS[data], offs)
        o[:, 3], o[:, 5] = _repeated_lines(data, offs, w)
        o[:, 4] = _repeated_words(w)
        o[:, 6] = K.sums_by((data >= 65) & (data <= 90), offs)
        o[:, 7] = K.sums_by((data >= 48) & (data <= 57), offs)
        o[:, 8] = K.sums_by((data == ord("!")) | (data == ord("?")), offs)
        o[:, 9] = np.diff(offs)
        o[:, 10] = K.sums_by((data & 0xDF >= 65) & (data & 0xDF <= 90) | (data >= 0x80), offs)
    return out


def _repeated_lines(data, offs, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and all lines with a word."""
    docs = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offs[:-1], breaks + 1)).astype(np.int64)) if len(data) else np.zeros(0, np.int64)
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    first = np.searchsorted(w.start, start)
    has = (first < len(w.start)) & (np.append(w.start, len(data))[first] < end)
    start, end = start[has], end[has]
    doc = np.searchsorted(offs, start, "right") - 1
    h = K.span_hash(data, start, end)
    h = K.mix(h ^ K.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    again = np.ones(len(h), bool)
    again[order[K.group_starts(h[order])]] = False
    return np.bincount(doc, again, docs).astype(np.int64), np.bincount(doc, minlength=docs)


def _repeated_words(w: K.Words) -> np.ndarray:
    """Words of each text in windows that the text has twice or more."""
    n = len(w.hash)
    if n < WINDOW:
        return np.zeros(len(w.count), np.int64)
    m = n - WINDOW + 1
    at = np.flatnonzero(w.doc[:m] == w.doc[WINDOW - 1 :])
    h = K.part_hash(K.prefix_hash(w.hash), at, at + WINDOW) ^ K.mix(w.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    first = K.group_starts(h[order])
    size = np.diff(np.append(first, len(h)))
    twice = at[order[np.repeat(size > 1, size)]]
    hit = np.zeros(n, bool)
    for k in range(WINDOW):
        hit[twice + k] = True
    return K.sums_by(hit, w.offs)


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from COUNTS."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    words, bytes_, letters = (np.maximum(c[x], 1) for x in ("n_words", "n_bytes", "n_letters"))
    lines = np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            c["n_upper"] / letters, c["n_digits"] / bytes_, c["n_marks"] / words, np.log1p(c["n_words"] / lines),
        ],
        axis=1,
    )


class Trees:
    """Boosted regression trees for log loss, as flat node arrays."""

    def __init__(self, feature, threshold, left, value, roots, bias: float):
        self.feature, self.threshold, self.left, self.value, self.roots, self.bias = feature, threshold, left, value, roots, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class; children of a node stand side by side, a leaf is its own child."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                leaf = self.left[node] < 0
                if leaf.all():
                    break
                step = self.left[node] + (x[rows, self.feature[node]] > self.threshold[node])
                node = np.where(leaf, node, step)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 5.0, l2: float = 1.0, bins: int = 64) -> Trees:
    """Histogram boosting. A split on a constrained feature must order its children's values, and the midpoint bounds what is
    below either child, so the sum is monotonic in that feature."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    total = np.full(len(y), bias)
    feature, threshold, left, value, roots = [], [], [], [], []

    def add(v: float) -> int:
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(v)
        return len(value) - 1

    def best(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + l2), low), high)

    gain_of = lambda g, h, v: -(g * v + 0.5 * (h + l2) * v * v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        roots.append(add(0.0))
        open_ = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_:
            node, rows, low, high, level = open_.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            v = best(g, h, low, high)
            top = (1e-9, None)
            for k in range(x.shape[1] if level < depth else 0):
                b = binned[rows, k]
                n = len(edges[k]) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                lv = np.clip(-cg / (ch + l2), low, high)
                rv = np.clip(-(g - cg) / (h - ch + l2), low, high)
                ok = (cn >= least) & (len(rows) - cn >= least) & ((rv - lv) * signs[k] >= 0)
                gain = np.where(ok, gain_of(cg, ch, lv) + gain_of(g - cg, h - ch, rv) - gain_of(g, h, v), -np.inf)
                if len(gain) and gain.max() > top[0]:
                    at = int(gain.argmax())
                    top = (gain[at], (k, at, lv[at], rv[at]))
            if top[1] is None:
                value[node] = v * rate
                total[rows] += v * rate
                continue
            k, at, lv, rv = top[1]
            feature[node], threshold[node] = k, float(edges[k][at])
            a, b = add(0.0), add(0.0)
            left[node] = a
            goes = binned[rows, k] > at
            mid = (lv + rv) / 2
            lo, hi = ((low, mid), (mid, high)) if signs[k] > 0 else ((mid, high), (low, mid)) if signs[k] < 0 else ((low, high), (low, high))
            open_ += [(a, rows[~goes], *lo, level + 1), (b, rows[goes], *hi, level + 1)]
    arrays = [np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots)]
    return Trees(*arrays, bias)


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its texts, with COUNTS."""
    keep = [c for c in df.columns if c != text and c.lower() not in COUNTS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = statistics(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(counts[:, k]) for k in range(len(COUNTS))], names=[*keep, *COUNTS])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(rows, schema)


def train(counts: DataFrame, labels: DataFrame, id_column: str, train_rows: int) -> Trees | None:
    """Trees for the quality label (0 or 1) of the documents."""
    known = labels.where("quality is not null").groupBy(id_column).agg(F.min("quality").alias("_quality"))
    step = max(1, -(-known.count() // train_rows))
    sample = counts.join(known, id_column).where(F.pmod(F.xxhash64(id_column), F.lit(step)) == 0).select("_quality", *COUNTS)
    got = np.array([tuple(r) for r in sample.collect()], np.int64).reshape(-1, len(COUNTS) + 1)
    if len(np.unique(got[:, 0])) < 2:
        return None
    return fit(features(got[:, 1:]), got[:, 0].astype(float), tuple(s for _, s in FEATURES))


def judge(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", train_rows: int = 20000, least: float = 0.5) -> DataFrame:
    """df without its texts, with COUNTS, base_failed, quality_score and kept.

    base_failed: under 50 words, or over half of them in repeated windows. kept: not base_failed, and the trees' probability
    of good quality is at least `least`.
    """
    counts = cut_lineage(counted(df, text), "statistics")
    trees = train(counts, labels, id_column, train_rows)

    @F.pandas_udf("double")
    def score(*cols):
        x = features(np.stack([c.to_numpy() for c in cols], 1))
        return cols[0].__class__(trees.score(x) if trees else np.ones(len(x)), index=cols[0].index)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts.withColumn("base_failed", failed).withColumn("quality_score", score(*COUNTS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= least))


def keep_good(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", train_rows: int = 20000, least: float = 0.5) -> DataFrame:
    """The rows of df that judge() keeps, with all their columns; no row is moved."""
    trees = train(counted(df.select(id_column, text), text), labels, id_column, train_rows)
    at = df.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = statistics(batch.column(at))
            good = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
            if trees and len(counts):
                good &= trees.score(features(counts)) >= least
            yield batch.filter(pa.array(good))

    return df.mapInArrow(rows, df.schema)
