"""Token tables: collapse, detokenising, merge words, self-overlap removal, monotonic confirmation."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterlake.functions import arrays as A
from utterlake.functions import text as X
from utterlake.operators.ordered import Running, running


def ctc_collapse(df: DataFrame, keys: list[str], order: str, token: str, blank: int) -> DataFrame:
    """Drop blanks and repeats of the token right before."""
    d = running(df, keys, order, {"_prev": Running("prev", F.col(token))})
    return d.where((F.col(token) != blank) & ~F.col(token).eqNullSafe(F.col("_prev"))).drop("_prev")


def joined(df: DataFrame, keys: list[str], order: str, column: str, name: str, sep: str = "") -> DataFrame:
    """Ordered concatenation per key, a key being one utterance's text."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, column))).alias("_l"))
    return g.select(*keys, F.array_join(F.col(f"_l.{column}"), sep).alias(name))


def pieces_to_text(df: DataFrame, vocab: DataFrame, keys: list[str], order: str, token: str) -> DataFrame:
    """Text of token ids; ids outside the vocabulary are left out."""
    pieces = df.join(vocab.select(F.col("id").alias(token), "piece"), token)
    d = joined(pieces, keys, order, "piece", "text")
    plain = F.regexp_replace(F.translate("text", X.WORD_MARK, " "), " +", " ")
    return d.withColumn("text", F.trim(plain))


def ctc_detokenize(
    df: DataFrame, vocab: DataFrame, keys: list[str], order: str, token: str, delimiter: str | None = None
) -> DataFrame:
    """Text of collapsed ids: a marked piece and the delimiter both stand for one space."""
    piece = F.regexp_replace("piece", f"^{X.WORD_MARK}", " ")
    if delimiter is not None:
        piece = F.when(F.col("piece") == delimiter, " ").otherwise(piece)
    d = df.join(vocab.select(F.col("id").alias(token), "piece"), token).withColumn("piece", piece)
    out = joined(d, keys, order, "piece", "text")
    return out.withColumn("text", F.trim(F.regexp_replace("text", " +", " ")))


def with_merge_words(df: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """Add base_words and next_words: normalised words of the last 128 and first 128 tokens.

    These are the rule's own bounds. Tokens are looked up by an equi-join and put back in order per row.
    """
    v = vocab.select("id", "word")

    def words(tokens: Column, name: str) -> DataFrame:
        d = df.select(*keys, F.posexplode(tokens).alias("pos", "id")).join(v, "id", "left")
        g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
        known = F.filter(F.col("w.word"), lambda w: w.isNotNull())
        return g.select(*keys, X.alnum_words(known).alias(name))

    base = words(A.take_last(F.col("tokens"), 128), "base_words")
    after = words(F.slice("next_tokens", 1, 128), "next_words")
    none = F.array().cast("array<string>")
    return (
        df.join(base, keys, "left")
        .join(after, keys, "left")
        .withColumn("base_words", F.coalesce("base_words", none))
        .withColumn("next_words", F.coalesce("next_words", none))
    )


def _overlaps(norm: list[str]) -> dict[tuple[int, int], int]:
    """Longest overlap of two words or more per (split, skip): the words before the split come again
    after it, at most two words later. Only positions that start a repeated word pair are tried."""
    n = len(norm)
    pairs = list(zip(norm, norm[1:]))
    counts = Counter(pairs)
    if len(counts) == len(pairs):
        return {}
    starts: dict[tuple[str, str], list[int]] = {}
    for i, pair in enumerate(pairs):
        if counts[pair] > 1:
            starts.setdefault(pair, []).append(i)
    longest: dict[tuple[int, int], int] = {}
    for places in starts.values():
        for x, i in enumerate(places):
            for j in places[x + 1 :]:
                for skip in range(3):
                    k = j - i - skip
                    tail = n - j
                    if k < 2 or k > tail or skip > max(0, n - (i + k) - 1):
                        continue
                    if norm[i : i + k] == norm[j : j + k]:
                        at = (i + k, skip)
                        longest[at] = max(k, longest.get(at, 0))
    return longest


def _collapse_once(words: list[str], norm: list[str]) -> tuple[list[str], list[str]] | None:
    n = len(words)
    if n < 4:
        return None
    best = None
    for (split, skip), over in sorted(_overlaps(norm).items()):
        tail = n - split - skip
        if over >= 3 or over == tail:
            size = split + tail - over
            if best is None or size < best[0]:
                best = (size, split, split + skip + over)
    if best is None:
        return None
    _, cut, resume = best
    return words[:cut] + words[resume:], norm[:cut] + norm[resume:]


def _edge_norm(word: str) -> str:
    start, end = 0, len(word)
    while start < end and unicodedata.category(word[start])[0] == "P":
        start += 1
    while end > start and unicodedata.category(word[end - 1])[0] == "P":
        end -= 1
    return word[start:end].lower()


def collapse_words(words: list[str], norms: dict[str, str] | None = None) -> list[str]:
    """Self-overlap removal of one list, pass after pass until none gains. ``norms`` remembers the
    plain form of words between calls."""
    norms = {} if norms is None else norms
    plain = list(map(norms.get, words))
    if None in plain:
        for w in words:
            if w not in norms:
                if len(norms) >= 1 << 16:
                    norms.clear()
                norms[w] = _edge_norm(w)
        plain = [norms.get(w) or _edge_norm(w) for w in words]
    state = (list(words), plain)
    while (after := _collapse_once(*state)) is not None:
        state = after
    return state[0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def collapse_self_overlap(lists: pd.Series) -> pd.Series:
    norms: dict[str, str] = {}
    return lists.map(lambda words: collapse_words(words, norms))


def monotonic_confirm(df: DataFrame, keys: list[str], order: str, words: str) -> DataFrame:
    """Running confirmed list per row: a candidate counts only if it extends the one held so far.

    Whether it counts depends on all before it, so a key is read in order, by one task; rows stream through it sorted, and
    only the list held so far is kept. Each candidate is compared once, as far as the held list reaches: the work grows with the words.
    A null candidate changes nothing; equal keys and orders come in any order.
    """
    d = df.select(*keys, order, words).repartition(*keys).sortWithinPartitions(*keys, order)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, order)) + ", confirmed array<string>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out = []
            for now, candidate in zip(zip(*[batch.column(c).to_pylist() for c in keys], strict=True), batch.column(words).to_pylist(), strict=True):
                if now != key:
                    key, held = now, candidate
                elif candidate is not None and (held is None or candidate[: len(held)] == held):
                    held = candidate
                out.append(held)
            columns = [batch.column(c) for c in (*keys, order)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.string()))], names=[*keys, order, "confirmed"])

    return d.mapInArrow(rows, schema)
