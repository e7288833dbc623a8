"""Sharding, mixing and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import odd_rows
from utterlake.llm.mixing import mix_sources, mixed_documents, mixed_texts, permute
from utterlake.llm.queries import QUERIES
from utterlake.llm.sharding import shuffle_shards, write_shards


def check_slots(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(odd, empty, spark, tmp_path):
    done = shuffle_shards(odd, shards=4, bucket_bytes=5000)
    assert set(done.columns) == {*odd.columns, "shard", "slot"}
    rows = done.collect()
    check_slots(rows, 4)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in odd_rows())
    again = shuffle_shards(odd.repartition(2), shards=4, bucket_bytes=5000).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    other = shuffle_shards(odd, shards=4, bucket_bytes=5000, seed=2).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} != {(r.doc_id, r.shard, r.slot) for r in other}
    assert shuffle_shards(empty).count() == 0
    write_shards(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_sharding_query(spark, sf, docs):
    rows = QUERIES["op7_sharding"](spark, sf).collect()
    check_slots(rows, 16)
    assert len({r.doc_id for r in rows}) == docs.count()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        got = permute(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mixing(odd, empty):
    rows = mixed_documents(odd, block=8).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len(brute.words(r[1]))) for r in odd_rows())
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute.targets([sizes[s] for s in order]), strict=True))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in order:
        assert abs(taken[s] - want[s]) <= 16
    again = mixed_documents(odd.repartition(2), block=8).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    assert mixed_documents(empty).count() == 0 and mixed_texts(empty).count() == 0


def test_mixed_texts(odd):
    given = {r[0]: Counter(brute.words(r[1])) for r in odd_rows()}
    for r in mixed_texts(odd, block=8).collect():
        have = Counter(brute.words(r.text))
        assert have and not have - given[r.doc_id] and r.turn in (0, 1)


def test_slots_fill_the_mix_without_gaps(docs):
    _, pieces = mix_sources(docs, shard_slots=64)
    rows = pieces.groupBy("out_shard").count().collect()
    assert len(rows) > 3 and min(r["count"] for r in rows) > 16


def test_mixing_query(spark, sf):
    rows = QUERIES["op8_mixing"](spark, sf).collect()
    total, target = Counter(), {}
    for r in rows:
        total[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
    for s, t in target.items():
        assert abs(total[s] - t) <= 48


def test_pipeline(spark, sf, docs):
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    good = stages["quality_rules"](spark, docs, sf).collect()
    for r in good:
        n, _, _, _, again = brute.statistics(r.text)
        assert n >= 50 and 2 * again <= n
    good_frame = spark.createDataFrame(good, docs.schema)
    first = stages["near_dedup"](spark, good_frame, sf)
    want = set(brute.near_classes([(r.doc_id, r.text) for r in good]))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == want
    cut = stages["substring_dedup"](spark, first, sf)
    plain = brute.cut_bytes([rows[i].text for i in sorted(want)])
    got = {r.doc_id: r for r in cut.collect()}
    for i, (n, gone, spans, _) in zip(sorted(want), plain, strict=True):
        assert n - gone <= len(got[i].text.encode()) <= n - gone + 6 * spans and got[i].n_chars == len(got[i].text)
    mixed = stages["mixing"](spark, cut, sf)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert not Counter(brute.words(r.text)) - Counter(brute.words(got[r.doc_id].text))
    last = stages["pieces"](spark, mixed, sf)
    assert last.where("not lossless").count() == 0 and last.count() == mixed.count()


def test_stages_keep_odd_rows_and_columns(spark, sf, odd):
    """Nulls, repeated rows and columns whose names the operators use themselves; a frame outlives the stages called after it."""
    frame = odd.withColumnsRenamed({"slot": "turn", "kept": "_k2"}).withColumn("text", F.coalesce("text", F.lit("")))
    frames = [(name, stage(spark, frame, sf)) for name, stage in corpus_pipeline.STAGES[:-1]]
    want = {r.doc_id: r for r in frame.collect()}
    for name, done in frames:
        rows = done.collect()
        assert done.columns == frame.columns, name
        for r in rows:
            assert (r._k1, r.lang, r.source) == (want[r.doc_id]._k1, want[r.doc_id].lang, want[r.doc_id].source) and r.turn in ("clash", None)
    assert frames[2][1].count() == frame.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_pipeline_run(spark, sf):
    a = corpus_pipeline.run(spark, sf)
    assert a.count() > 0 and a.where("not lossless").count() == 0


def test_pipeline_stages_take_empty_tables(spark, sf, docs):
    frame = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        assert frame.count() == 0


def test_scratch_tables_leave_the_catalog(spark, sf):
    """A query's scratch table has no name in the catalog that would stay; its rows are read from the files, still bucketed."""
    from utterlake.session import bucketed

    before = {t.name for t in spark.catalog.listTables()}
    frames = [QUERIES[name](spark, sf) for name in ("op3_suffix_dedup", "op6_lm_scoring", "op10_minhash_dedup")]
    table = bucketed(spark.range(300).withColumn("k", F.col("id") % 7), 4, ["k"], "texts")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [f.select("doc_id").distinct().count() for f in frames] == [200, 200, 200]
    both = table.join(table.withColumnsRenamed({"k": "_k", "id": "_id"}).hint("merge"), F.col("k") == F.col("_k"))
    assert both.count() == sum(len(range(k, 300, 7)) ** 2 for k in range(7))
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
