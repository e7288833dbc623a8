"""Transcript scoring queries: joins of references and hypotheses, error rates, gates, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.functions import text as X
from utterlake.operators import joins as J
from utterlake.operators import metrics as M
from utterlake.plans import fixtures as fx
from utterlake.plans.fixture_sql import words_sql
from utterlake.plans.registry import query

def matched(spark, sf):
    """References joined to both hypotheses on shared ids."""
    hyps = fx.hyp(spark, sf).drop("conv_id", "turn")
    return fx.ref(spark, sf).withColumnRenamed("text", "ref").join(hyps, "id")


def pairs(spark, sf):
    """One row per id and system with word lists."""
    systems = F.array(
        F.struct(F.lit("a").alias("sys"), F.col("hyp_a").alias("hyp"), F.col("infer_a").alias("infer_sec")),
        F.struct(F.lit("b").alias("sys"), F.col("hyp_b").alias("hyp"), F.col("infer_b").alias("infer_sec")),
    )
    d = matched(spark, sf).select("id", "conv_id", "turn", "ref", "audio_sec", F.inline(systems))
    return d.withColumn("ref_words", X.tokenize(F.col("ref"))).withColumn("hyp_words", X.tokenize(F.col("hyp")))


def scored(spark, sf):
    return (
        M.spread(pairs(spark, sf), "id")
        .withColumn("dist", M.edit_distance(F.col("ref_words"), F.col("hyp_words")))
        .select(
            "id",
            "conv_id",
            "turn",
            "sys",
            "audio_sec",
            "infer_sec",
            F.size("ref_words").cast("bigint").alias("n_ref"),
            F.size("hyp_words").cast("bigint").alias("n_hyp"),
            "dist",
        )
    )


WER_SQL = "CASE WHEN n_ref = 0 THEN CASE WHEN n_hyp = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE CAST(dist AS DOUBLE) / n_ref END"
WER_B_SQL = "CASE WHEN n_ref = 0 THEN 0.0::DOUBLE ELSE CAST(dist AS DOUBLE) / n_ref END"


def wer():
    return M.sentence_wer(F.col("dist"), F.col("n_ref"), F.col("n_hyp"))


@query(
    "jn1_inner_join_shared_ids",
    "SELECT r.id, length(r.text) AS ref_chars, length(h.hyp_a) AS hyp_chars FROM v_ref r JOIN v_hyp h ON r.id = h.id",
)
def _(spark, sf):
    return matched(spark, sf).select(
        "id",
        F.length("ref").cast("bigint").alias("ref_chars"),
        F.length("hyp_a").cast("bigint").alias("hyp_chars"),
    )


@query(
    "jn2_semi_anti_ids",
    """SELECT id, 'matched' AS side FROM v_ref WHERE id IN (SELECT id FROM v_hyp)
    UNION ALL SELECT id, 'missing' FROM v_ref WHERE id NOT IN (SELECT id FROM v_hyp)""",
)
def _(spark, sf):
    r, h = fx.ref(spark, sf).select("id"), fx.hyp(spark, sf).select("id")
    kept = r.join(h, "id", "left_semi").withColumn("side", F.lit("matched"))
    return kept.unionByName(r.join(h, "id", "left_anti").withColumn("side", F.lit("missing")))


def overlap(spark, sf):
    p = pairs(spark, sf).where("sys = 'a'")
    totals = J.multiset_overlap(J.word_counts(p, "id", "ref_words"), J.word_counts(p, "id", "hyp_words"), "id")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("left_words", "right_words", "overlap")]
    # Ids whose two texts are both empty have no words to count.
    return p.select("id").join(totals, "id", "left").select("id", *zero)


COUNTS_SQL = """(SELECT p.id, len(p.r) AS left_words, len(p.h) AS right_words, coalesce(o.overlap, 0) AS overlap
  FROM v_pair p LEFT JOIN (
    SELECT id, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS overlap FROM
      (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(r) AS word FROM v_pair WHERE sys = 'a') GROUP BY 1, 2) a
      FULL OUTER JOIN (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(h) AS word FROM v_pair WHERE sys = 'a') GROUP BY 1, 2) b
      USING (id, word) GROUP BY id) o ON o.id = p.id WHERE p.sys = 'a')"""


@query("jn3_multiset_overlap_join", f"SELECT id, left_words, right_words, overlap FROM {COUNTS_SQL}")
def _(spark, sf):
    return overlap(spark, sf)


@query(
    "ag6_overlap_precision_recall",
    f"""SELECT id, round(CASE WHEN right_words = 0 THEN 1.0::DOUBLE WHEN left_words = 0 THEN 0.0::DOUBLE ELSE overlap / right_words END, 6) AS precision,
      round(CASE WHEN left_words = 0 THEN 1.0::DOUBLE WHEN right_words = 0 THEN 0.0::DOUBLE ELSE overlap / left_words END, 6) AS recall
    FROM {COUNTS_SQL}""",
)
def _(spark, sf):
    d = M.precision_recall(overlap(spark, sf))
    return d.select("id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "jn10_paired_systems",
    f"""SELECT a.id, round(a.wer, 6) AS wer_a, round(b.wer, 6) AS wer_b, round(a.infer_sec, 6) AS infer_a, round(b.infer_sec, 6) AS infer_b
    FROM (SELECT *, {WER_B_SQL} AS wer FROM v_wer WHERE sys = 'a') a JOIN (SELECT *, {WER_B_SQL} AS wer FROM v_wer WHERE sys = 'b') b USING (id)""",
)
def _(spark, sf):
    return paired(spark, sf).select("id", *[F.round(c, 6).alias(c) for c in ("wer_a", "wer_b", "infer_a", "infer_b")])


def paired(spark, sf):
    """Both systems side by side per id."""
    d = scored(spark, sf).withColumn("wer", M.sentence_wer_paired(F.col("dist"), F.col("n_ref")))
    side = lambda c, s: F.max(F.when(F.col("sys") == s, F.col(c)))
    return d.groupBy("id").agg(
        side("wer", "a").alias("wer_a"),
        side("wer", "b").alias("wer_b"),
        side("infer_sec", "a").alias("infer_a"),
        side("infer_sec", "b").alias("infer_b"),
    )


@query(
    "jn11_containment_join",
    f"""SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || array_to_string({words_sql('text')}, ' ') || ' ' AS d FROM documents),
      (SELECT item_id, ' ' || array_to_string({words_sql('text')}, ' ') || ' ' AS p FROM benchmark) WHERE contains(d, p)""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", X.tokenize(F.col("text")).alias("words"))
    items = fx.table(spark, sf, "benchmark").select("item_id", X.tokenize(F.col("text")).alias("words"))
    return J.containment(docs, items, "doc_id", "item_id")


@query(
    "jn12_adjacent_segments",
    "SELECT conv_id, turn, len(words) - len(prev_words) AS growth FROM v_conv WHERE len(prev_words) > 0",
)
def _(spark, sf):
    d = fx.table(spark, sf, "conversations").select("conv_id", "turn", X.tokenize(F.col("text")).alias("words"))
    d = J.previous_segment(d, ["conv_id"], "turn", "words", "prev").where(F.size("prev") > 0)
    return d.select("conv_id", "turn", (F.size("words") - F.size("prev")).cast("bigint").alias("growth"))


@query("ag1_word_edit_distance", "SELECT id, sys, n_ref, n_hyp, dist FROM v_wer")
def _(spark, sf):
    return scored(spark, sf).select("id", "sys", "n_ref", "n_hyp", "dist")


@query(
    "ag2_sentence_wer",
    f"SELECT id, sys, round({WER_SQL}, 6) AS wer, round({WER_B_SQL}, 6) AS wer_paired FROM v_wer",
)
def _(spark, sf):
    alt = M.sentence_wer_paired(F.col("dist"), F.col("n_ref"))
    return scored(spark, sf).select("id", "sys", F.round(wer(), 6).alias("wer"), F.round(alt, 6).alias("wer_paired"))


@query(
    "ag3_corpus_wer_weighted",
    f"""SELECT sys, count(*) AS pairs, round(sum({WER_SQL} * greatest(n_ref, 1)) / greatest(sum(greatest(n_ref, 1)), 1), 6) AS wer,
      round(sum(audio_sec), 3) AS audio_sec, round(sum(infer_sec), 3) AS infer_sec, round(sum(infer_sec) / sum(audio_sec), 6) AS rtf
    FROM v_wer GROUP BY sys""",
)
def _(spark, sf):
    d = scored(spark, sf).withColumn("wer", wer())
    return d.groupBy("sys").agg(
        F.count("*").alias("pairs"),
        F.round(M.weighted_wer(F.col("wer"), F.col("n_ref")), 6).alias("wer"),
        F.round(F.sum("audio_sec"), 3).alias("audio_sec"),
        F.round(F.sum("infer_sec"), 3).alias("infer_sec"),
        F.round(M.rtf(F.sum("infer_sec"), F.sum("audio_sec")), 6).alias("rtf"),
    )


@query(
    "ag4_corpus_wer_total_edits",
    """SELECT sys, CAST(sum(dist) FILTER (WHERE n_ref > 0) AS BIGINT) AS edits, CAST(sum(n_ref) AS BIGINT) AS ref_words,
      round(sum(dist) FILTER (WHERE n_ref > 0) / sum(n_ref) FILTER (WHERE n_ref > 0), 6) AS wer FROM v_wer GROUP BY sys""",
)
def _(spark, sf):
    used = F.col("n_ref") > 0
    return scored(spark, sf).groupBy("sys").agg(
        F.sum(F.when(used, F.col("dist"))).alias("edits"),
        F.sum("n_ref").alias("ref_words"),
        F.round(M.total_edit_wer(F.col("dist"), F.col("n_ref")), 6).alias("wer"),
    )


@query(
    "ag5_totals_and_rtf",
    """SELECT conv_id, round(sum(audio_sec), 4) AS audio_sec, round(sum(infer_a), 4) AS infer_sec,
      CASE WHEN sum(audio_sec) > 0 AND sum(infer_a) > 0 THEN round(sum(infer_a) / sum(audio_sec), 6) END AS rtf,
      CASE WHEN sum(audio_sec) > 0 AND sum(infer_a) > 0 THEN round(sum(audio_sec) / sum(infer_a), 6) END AS rtfx
    FROM v_hyp GROUP BY conv_id""",
)
def _(spark, sf):
    a, i = F.sum("audio_sec"), F.sum("infer_a")
    return fx.hyp(spark, sf).groupBy("conv_id").agg(
        F.round(a, 4).alias("audio_sec"),
        F.round(i, 4).alias("infer_sec"),
        F.round(M.rtf(i, a), 6).alias("rtf"),
        F.round(M.rtf(a, i), 6).alias("rtfx"),
    )


TRIGRAM_SQL = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"


@query(
    "ag9_ngram_duplication",
    f"""SELECT doc_id, CASE WHEN len(g) = 0 THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE - CAST(len(list_distinct(g)) AS DOUBLE) / len(g), 6) END AS dup
    FROM (SELECT doc_id, {TRIGRAM_SQL} AS g FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents))""",
)
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", X.tokenize(F.col("text")).alias("w"))
    return d.select("doc_id", F.round(M.ngram_duplication(F.col("w"), 3), 6).alias("dup"))


@query(
    "ag20_quality_gate",
    f"""SELECT id, coalesce(recall, 0) >= 0.6 AS recall_ok, coalesce(dup, 1) <= 0.25 AS dup_ok,
      coalesce(recall, 0) >= 0.6 AND coalesce(dup, 1) <= 0.25 AND coalesce(one_minus_wer, 0) >= 0.7 AS pass
    FROM (SELECT c.id, CASE WHEN left_words = 0 THEN 1.0::DOUBLE WHEN right_words = 0 THEN 0.0::DOUBLE ELSE overlap / left_words END AS recall,
            (SELECT 1.0::DOUBLE) - {WER_SQL} AS one_minus_wer,
            CASE WHEN len(p.h) < 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct({TRIGRAM_SQL.replace('w[', 'p.h[').replace('len(w)', 'len(p.h)')})) / (len(p.h) - 2) END AS dup
      FROM {COUNTS_SQL} c JOIN v_wer w ON w.id = c.id AND w.sys = 'a' JOIN v_pair p ON p.id = c.id AND p.sys = 'a')""",
)
def _(spark, sf):
    from utterlake.operators.gates import quality_gate

    p = pairs(spark, sf).where("sys = 'a'")
    facts = p.select(
        "id",
        (1.0 - M.sentence_wer(M.edit_distance(F.col("ref_words"), F.col("hyp_words")), F.size("ref_words"), F.size("hyp_words"))).alias("similarity"),
        M.ngram_duplication(F.col("hyp_words"), 3).alias("dup"),
    )
    d = M.precision_recall(overlap(spark, sf)).join(facts, "id")
    return quality_gate(d, "similarity", "recall", "dup").select("id", "recall_ok", "dup_ok", "pass")


@query("ag21_sequence_match_ratio")
def _(spark, sf):
    d = pairs(spark, sf).where("sys = 'a'").select("id", "ref", "hyp")
    return M.spread(d, "id").select(
        "id",
        F.round(M.sequence_ratio("ref", "hyp"), 6).alias("chars"),
        F.round(M.sequence_ratio_words("ref", "hyp"), 6).alias("words"),
    )


@query(
    "ag22_average_paired_delta",
    f"""SELECT count(*) AS pairs, round(avg(a.wer - b.wer), 6) AS delta
    FROM (SELECT id, {WER_B_SQL} AS wer FROM v_wer WHERE sys = 'a') a JOIN (SELECT id, {WER_B_SQL} AS wer FROM v_wer WHERE sys = 'b') b USING (id)""",
)
def _(spark, sf):
    d = paired(spark, sf)
    return d.agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("wer_a") - F.col("wer_b")), 6).alias("delta"))


@query(
    "tk1_worst_deltas",
    f"""SELECT id, round(a.wer - b.wer, 6) AS delta
    FROM (SELECT id, {WER_B_SQL} AS wer FROM v_wer WHERE sys = 'a') a JOIN (SELECT id, {WER_B_SQL} AS wer FROM v_wer WHERE sys = 'b') b USING (id)
    ORDER BY a.wer - b.wer DESC, id LIMIT 10""",
)
def _(spark, sf):
    d = paired(spark, sf).withColumn("delta", F.col("wer_a") - F.col("wer_b"))
    return d.orderBy(F.desc("delta"), "id").limit(10).select("id", F.round("delta", 6).alias("delta"))


@query("tk6_sample_limit", "SELECT id, length(text) AS chars FROM v_ref ORDER BY conv_id, turn LIMIT 100")
def _(spark, sf):
    d = fx.ref(spark, sf).orderBy("conv_id", "turn").limit(100)
    return d.select("id", F.length("text").cast("bigint").alias("chars"))


@query("se1_shared_ids", "SELECT id FROM v_ref INTERSECT SELECT id FROM v_hyp")
def _(spark, sf):
    return fx.ref(spark, sf).select("id").intersect(fx.hyp(spark, sf).select("id"))


@query(
    "se2_vocabulary_union",
    """SELECT DISTINCT unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM v_ref
    UNION SELECT unnest(list_filter(string_split(hyp_a, ' '), lambda w: w <> '')) FROM v_hyp""",
)
def _(spark, sf):
    r = fx.ref(spark, sf).select(F.explode(X.tokenize(F.col("text"))).alias("word"))
    h = fx.hyp(spark, sf).select(F.explode(X.tokenize(F.col("hyp_a"))).alias("word"))
    return r.union(h).distinct()
