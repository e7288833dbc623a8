"""Word-list and token-list functions on built-in array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlake.functions.text import edge_punct_norm, strip_all


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expression once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def count_to(n: Column) -> Column:
    """1..n as an array, empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n.cast("int")))


def drop_first(words: Column, n: Column) -> Column:
    return F.slice(words, n.cast("int") + 1, F.size(words))


def take_first(words: Column, n: Column) -> Column:
    return F.slice(words, 1, n.cast("int"))


def take_last(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))


def lcp_len(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    miss = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return let(miss, lambda p: F.when(p == 0, F.size(a).cast("bigint")).otherwise(p - 1))


def lcp_all(lists: Column) -> Column:
    """Longest common prefix of a list of lists."""

    def body(l: Column) -> Column:
        first = F.get(l, F.lit(0))
        shortest = F.array_min(F.transform(l, lambda x: lcp_len(first, x)))
        return F.when(F.size(l) == 0, F.array().cast("array<string>")).otherwise(take_first(first, shortest))

    return let(lists, body)


def suffix_prefix_overlap(a: Column, b: Column, limit: int) -> Column:
    """Largest k up to ``limit`` with the last k of ``a`` equal to the first k of ``b``."""

    def body(p: Column) -> Column:
        x, y = p["x"], p["y"]
        n = F.size(x)
        # The two end words are compared first; few lengths get as far as the lists.
        fits = F.filter(
            count_to(F.least(F.lit(limit), n, F.size(y))),
            lambda k: (F.get(y, k - 1) == p["end"])
            & (F.get(x, n - k) == p["start"])
            & (F.slice(x, n - k + 1, k) == F.slice(y, F.lit(1), k)),
        )
        return F.coalesce(F.array_max(fits), F.lit(0)).cast("bigint")

    return let(
        F.struct(a.alias("x"), b.alias("y")),
        lambda q: let(
            F.struct(
                q["x"].alias("x"),
                q["y"].alias("y"),
                F.get(q["x"], F.size(q["x"]) - 1).alias("end"),
                F.get(q["y"], F.lit(0)).alias("start"),
            ),
            body,
        ),
    )


def suffix_prefix_overlap_norm(a: Column, b: Column, limit: int) -> Column:
    """The overlap on words without edge punctuation and case."""
    return let(
        F.struct(F.transform(a, edge_punct_norm).alias("a"), F.transform(b, edge_punct_norm).alias("b")),
        lambda s: suffix_prefix_overlap(s["a"], s["b"], limit),
    )


def fenced(items: Column) -> Column:
    """A list as one string in which contiguous containment is substring containment."""
    return F.concat(F.lit(" "), F.array_join(items.cast("array<string>"), " "), F.lit(" "))


def contains_subsequence(haystack: Column, needle: Column) -> Column:
    """Contiguous containment; an empty needle is always contained."""
    return (F.size(needle) == 0) | F.contains(fenced(haystack), fenced(needle))


def longest_known_prefix(window: Column, segment: Column, shortest: int, longest: int) -> Column:
    """Longest prefix of ``segment`` found in ``window``, between the two bounds, else 0."""
    top = F.least(F.lit(longest), F.size(segment))

    # A prefix that is contained contains all shorter ones, so the border is found by halving.
    def bisect(t: Column) -> Column:
        start = F.struct(F.lit(shortest - 1).alias("low"), top.alias("high"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
            held = F.contains(t, fenced(F.slice(segment, F.lit(1), F.greatest(mid, F.lit(0)))))
            low = F.when(acc["low"] >= acc["high"], acc["low"]).when(held, mid).otherwise(acc["low"])
            high = F.when(acc["low"] >= acc["high"], acc["high"]).when(held, acc["high"]).otherwise(mid - 1)
            return F.struct(low.alias("low"), high.alias("high"))

        steps = F.sequence(F.lit(1), F.lit(max(1, (longest - shortest + 2).bit_length())))
        return F.aggregate(steps, start, halve, lambda acc: F.when(acc["low"] >= shortest, acc["low"]).otherwise(0))

    return let(fenced(window), bisect)


def append_with_overlap(
    base: Column,
    segment: Column,
    max_overlap: int = 256,
    search: int = 2048,
    shortest: int = 4,
    longest: int = 512,
) -> Column:
    """Append a segment to a base without repeating what the base already ends with or contains."""

    def extend(b: Column, s: Column, n: Column) -> Column:
        return F.concat(b, drop_first(s, n))

    def late(b: Column, s: Column) -> Column:
        known = longest_known_prefix(take_last(b, search), s, shortest, longest)
        return let(known, lambda k: extend(b, s, k))

    def early(b: Column, s: Column) -> Column:
        return let(
            suffix_prefix_overlap(b, s, max_overlap),
            lambda k: F.when(k > 0, extend(b, s, k)).otherwise(late(b, s)),
        )

    def body(p: Column) -> Column:
        b, s = p["b"], p["s"]
        contained = (F.size(s) >= shortest) & contains_subsequence(take_last(b, search), s)
        return (
            F.when(F.size(b) == 0, s).when((F.size(s) == 0) | contained, b).otherwise(early(b, s))
        )

    return let(F.struct(base.alias("b"), segment.alias("s")), body)


def append_tokens(base: Column, segment: Column) -> Column:
    """append_with_overlap with the bounds for token ids."""
    return append_with_overlap(base, segment, max_overlap=512, search=4096, shortest=8, longest=512)


MERGE_TYPE = "struct<merged:array<bigint>,strategy:string,alignment_start:int,match_length:int>"


def window_merge(base: Column, following: Column, search: int = 4096) -> Column:
    """Merge a re-decoded window into a base of token ids; says which rule applied."""

    def out(merged: Column, strategy: str, start: Column | None = None, length: Column | None = None) -> Column:
        return F.struct(
            merged.alias("merged"),
            F.lit(strategy).alias("strategy"),
            (F.lit(None) if start is None else start).cast("int").alias("alignment_start"),
            (F.lit(0) if length is None else length).cast("int").alias("match_length"),
        ).cast(MERGE_TYPE)

    def body(p: Column) -> Column:
        b, n = p["b"], p["n"]
        need = F.when(F.size(n) >= 16, 4).when(F.size(n) >= 8, 3).otherwise(2)
        # Only a position that holds the first token of the next window can start a match.
        skipped = F.greatest(F.size(b) - search, F.lit(0))
        reach = drop_first(b, skipped)
        starts = F.filter(F.transform(reach, lambda x, i: F.when(x == n[0], i + skipped)), lambda i: i.isNotNull())
        # A match is no longer than the next window, so no more of the base is copied for each start.
        scored = F.transform(
            starts,
            lambda i: F.struct(lcp_len(F.slice(b, i + 1, F.size(n)), n).alias("len"), (-i).alias("neg")),
        )
        best = F.array_max(scored)
        return (
            F.when(F.size(b) == 0, out(n, "seed_next"))
            .when(F.size(n) == 0, out(b, "keep_base"))
            .otherwise(
                let(
                    best,
                    lambda s: F.when(
                        s.isNotNull() & (s["len"] >= need),
                        out(F.concat(take_first(b, -s["neg"]), n), "aligned_replace", -s["neg"], s["len"]),
                    )
                    .when(F.size(n) >= F.size(b), out(n, "replace_all"))
                    .otherwise(out(append_tokens(b, n), "append_with_overlap")),
                )
            )
        )

    return let(F.struct(base.alias("b"), following.alias("n")), body)


def shared_word_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("bigint")


def refine_merge(result: Column, base: Column, base_words: Column, next_words: Column) -> Column:
    """Second look at a plain append, on words: keep the base where the tail is short or a replay."""

    def keep(strategy: str, length: Column) -> Column:
        return F.struct(
            base.alias("merged"),
            F.lit(strategy).alias("strategy"),
            F.lit(None).cast("int").alias("alignment_start"),
            length.cast("int").alias("match_length"),
        ).cast(MERGE_TYPE)

    def body(p: Column) -> Column:
        b, w = p["b"], p["w"]
        n = F.size(w)
        near = (suffix_prefix_overlap(b, w, 4) > 0) | (shared_word_count(take_last(b, 8), w) > 0)
        overlap = suffix_prefix_overlap(b, w, 8)
        shared = shared_word_count(take_last(b, 16), w)
        return (
            F.when(result["strategy"] != "append_with_overlap", result)
            .when(n == 0, keep("keep_base_empty_append", F.lit(0)))
            .when((n == 1) | ((n == 2) & near), keep("defer_short_append", n))
            .when(contains_subsequence(b, w), keep("keep_base_word_replay", n))
            .when(overlap >= F.least(F.lit(3), n - 1), keep("defer_word_overlap_append", overlap))
            .when((n <= 8) & (shared * 2 >= n), keep("defer_high_overlap_append", shared))
            .otherwise(result)
        )

    return let(F.struct(base_words.alias("b"), next_words.alias("w")), body)


# Merge outcomes that a rolling decode may take over.
ACCEPTED_MERGES = (
    "keep_base",
    "keep_base_empty_append",
    "keep_base_word_replay",
    "defer_short_append",
    "defer_word_overlap_append",
    "defer_high_overlap_append",
    "aligned_replace",
)


def accept_merge(strategy: Column, base_count: Column, next_count: Column) -> Column:
    return F.when(strategy == "seed_next", (base_count == 0) & (next_count > 0)).otherwise(
        strategy.isin(*ACCEPTED_MERGES)
    )


def draft_tail(confirmed: Column, draft: Column) -> Column:
    """Draft words not yet in the confirmed list."""

    def body(p: Column) -> Column:
        c, d = p["c"], p["d"]
        cut = F.greatest(lcp_len(c, d), suffix_prefix_overlap(c, d, 64))
        return F.when((F.size(c) == 0) | (F.size(d) == 0), d).otherwise(drop_first(d, cut))

    return let(F.struct(confirmed.alias("c"), draft.alias("d")), body)


def fold_merge(chunks: Column) -> Column:
    """Join word lists in order, dropping the words a chunk repeats from the end of the text so far."""
    return F.aggregate(
        chunks,
        F.array().cast("array<string>"),
        lambda acc, c: F.concat(acc, drop_first(c, suffix_prefix_overlap(acc, c, 64))),
    )


def argmax(values: Column) -> Column:
    """First index (from 0) of the largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def topk(values: Column, k: int) -> Column:
    """(score, index) pairs by score descending, then index ascending."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    return F.slice(F.array_sort(pairs), 1, k)


def log_softmax(values: Column) -> Column:
    def body(v: Column) -> Column:
        top = F.array_max(v)
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return let(top + F.log(total), lambda z: F.transform(v, lambda x: x - z))

    return let(values.cast("array<double>"), body)


def duration_select(scores: Column, is_blank: Column, durations: Column, margin: float) -> Column:
    """Index of the best duration; for blanks, the shortest positive one within the margin."""

    def body(p: Column) -> Column:
        s, d = p["s"], p["d"]
        best = argmax(s)
        near = F.filter(
            F.zip_with(
                s,
                F.transform(d, lambda x, i: F.struct(x.alias("duration"), i.alias("index"))),
                lambda score, di: F.struct(
                    di["duration"].alias("duration"), di["index"].alias("index"), score.alias("score")
                ),
            ),
            lambda x: (x["duration"] > 0) & x["score"].isNotNull() & (F.array_max(s) - x["score"] <= margin),
        )
        shortest = F.array_min(
            F.transform(near, lambda x: F.struct(x["duration"].alias("duration"), x["index"].alias("index")))
        )
        best_duration = F.get(d, best.cast("int"))
        replace = (
            is_blank
            & F.lit(margin > 0)
            & shortest.isNotNull()
            & ((F.coalesce(best_duration, F.lit(2**31 - 1)) <= 0) | (shortest["duration"] < F.coalesce(best_duration, F.lit(2**31 - 1))))
        )
        return F.when(replace, shortest["index"].cast("bigint")).otherwise(best)

    return let(F.struct(scores.alias("s"), durations.alias("d")), body)


def slice_or_pad(values: Column, length: int) -> Column:
    """Exactly ``length`` values, zeros at the end where the list is short."""
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(0.0), missing).cast("array<double>"))


def prefix_reuse(previous: Column, current: Column) -> Column:
    """How many leading entries are unchanged."""
    return lcp_len(previous, current)


def leading_true(flags: Column, limit: Column) -> Column:
    """Leading true flags, at most ``limit``."""
    bad = F.array_position(flags, False)
    run = F.when(bad == 0, F.size(flags).cast("bigint")).otherwise(bad - 1)
    return F.greatest(F.lit(0), F.least(run, limit)).cast("bigint")


def anchor_promote(previous: Column, current: Column, minimum: int) -> Column:
    shorter = F.least(F.size(previous), F.size(current))
    return let(
        lcp_len(previous, current),
        lambda p: (shorter >= minimum) & (p >= minimum) & (p * 4 >= shorter * 3),
    )


def rewrite_merge(previous: Column, current: Column, trimmed: Column) -> Column:
    """A rewritten window replaces the text unless history was trimmed; then it is appended."""
    return F.when(~trimmed, current).otherwise(append_with_overlap(previous, current))


def tail_frame_count(steps: Column, new_steps: Column, base: int, multiplier: int, min_tail: int) -> Column:
    return F.least(steps, F.greatest(F.lit(min_tail), F.lit(base), new_steps * multiplier))


def self_overlap_pass(words: Column) -> Column:
    """One pass of self-overlap removal; the same list where nothing is gained."""

    def body(p: Column) -> Column:
        w, norm = p["w"], p["n"]
        n = F.size(w)

        def candidate(split: Column, skip: Column) -> Column:
            tail = n - split - skip
            top = F.least(split, tail)
            over = F.coalesce(
                F.array_max(
                    F.filter(
                        count_to(top),
                        lambda k: F.slice(norm, split - k + 1, k) == F.slice(norm, split + skip + 1, k),
                    )
                ),
                F.lit(0),
            )
            return let(
                over,
                lambda o: F.when(
                    (o >= 3) | ((o == tail) & (tail >= 2)),
                    F.struct(
                        (split + tail - o).alias("size"),
                        split.alias("split"),
                        skip.alias("skip"),
                        o.alias("over"),
                    ),
                ),
            )

        tried = F.flatten(
            F.transform(
                count_to(n - 1),
                lambda split: F.transform(
                    F.filter(
                        F.array(F.lit(0), F.lit(1), F.lit(2)),
                        lambda skip: skip <= F.greatest(F.lit(0), n - split - 1),
                    ),
                    lambda skip: candidate(split, skip),
                ),
            )
        )
        best = F.array_min(F.filter(tried, lambda c: c.isNotNull()))
        return let(
            best,
            lambda c: F.when(
                (n >= 4) & c.isNotNull() & (c["size"] < n),
                F.concat(take_first(w, c["split"]), drop_first(w, c["split"] + c["skip"] + c["over"])),
            ).otherwise(w),
        )

    return let(F.struct(words.alias("w"), F.transform(words, edge_punct_norm).alias("n")), body)


def align_payload(results: Column, cursors: Column, stamps: Column) -> Column:
    """Parallel lists as one list of structs, cut to the shorter of texts and cursors, blank texts
    dropped, missing stamps as empty lists; null where nothing is left."""

    def body(p: Column) -> Column:
        n = F.least(F.size(p["r"]), F.size(p["c"]))
        rows = F.transform(
            count_to(n),
            lambda i: F.struct(
                strip_all(F.get(p["r"], i - 1)).alias("text"),
                F.get(p["c"], i - 1).alias("cursor"),
                F.coalesce(F.get(p["t"], i - 1), F.array().cast("array<double>")).alias("stamps"),
            ),
        )
        kept = F.filter(rows, lambda x: x["text"] != "")
        return let(kept, lambda k: F.when(F.size(k) > 0, k))

    return let(F.struct(results.alias("r"), cursors.alias("c"), stamps.alias("t")), body)


def percentile_of(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of the values in one array; null when empty."""

    def body(v: Column) -> Column:
        pos = (F.size(v) - 1) * F.lit(q)
        low = F.floor(pos).cast("int")
        high = F.ceil(pos).cast("int")
        a, b = F.get(v, low), F.get(v, high)
        return F.when(F.size(v) > 0, a + (b - a) * (pos - low))

    return let(F.array_sort(values), body)


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def std_of(values: Column) -> Column:
    """Population standard deviation of the values in one array."""
    return let(
        F.struct(values.alias("v"), mean_of(values).alias("m")),
        lambda p: F.sqrt(
            F.aggregate(p["v"], F.lit(0.0), lambda acc, x: acc + (x - p["m"]) * (x - p["m"])) / F.size(p["v"])
        ),
    )


def mixed_score(values: Column, kind: str) -> Column:
    """Outlier, range or spread score of absolute values; 0 for an empty list."""
    eps = 1e-8

    def body(v: Column) -> Column:
        if kind == "outlier":
            score = percentile_of(v, 0.999) / (percentile_of(v, 0.99) + eps)
        elif kind == "range":
            score = F.array_max(v) / (percentile_of(v, 0.95) + eps)
        elif kind == "std":
            score = std_of(v) / (mean_of(v) + eps)
        else:
            raise ValueError(kind)
        return F.coalesce(score, F.lit(0.0))

    return let(F.transform(values.cast("array<double>"), F.abs), body)


def stride_sample(values: Column, limit: int) -> Column:
    """At most ``limit`` values, every (len // limit)-th of a longer list."""

    def body(v: Column) -> Column:
        step = F.floor(F.size(v) / limit).cast("int")
        picked = F.slice(F.filter(v, lambda x, i: i % step == 0), 1, limit)
        return F.when(F.size(v) > limit, picked).otherwise(v)

    return let(values, body)
