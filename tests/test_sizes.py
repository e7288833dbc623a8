"""Queries against their SQL where tables come in more files, or hold other values, than the small ones; and what plans move."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, cell, key


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    got = sorted((tuple(cell(v) for v in r) for r in df.collect()), key=key)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert got == sorted((tuple(cell(r[i]) for i in at) for r in cur.fetchall()), key=key)
    return got


@pytest.fixture
def many_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["sk4_stream_trace_jsonl", "st12_batch_trace"])
def test_a_traced_batch_may_have_many_files(spark, many_files, name):
    assert len(compare(spark, "/root/testdata/sf0.01", name)) == 2  # 150 files a half


def test_average_passes_over_unusable_values(spark, sf, tmp_path):
    odd = "CASE WHEN event_id % 4 < 2 THEN value WHEN event_id % 28 = 2 THEN 0 WHEN event_id % 28 = 3 THEN -5 WHEN event_id % 28 = 6 THEN 'nan' WHEN event_id % 28 = 7 THEN 'inf' WHEN event_id % 28 = 10 THEN NULL ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd} AS value) FROM '{sf}/events.parquet' WHERE user_id < 40) TO '{tmp_path}/events.parquet'")
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    assert compare(spark, str(tmp_path), "st8_ewma_adaptive_increment")


@pytest.mark.parametrize("name", ["ar2_lcp_all", "ar3_suffix_prefix_overlap", "ar4_suffix_prefix_overlap_norm", "ar5_contains_subsequence", "ar11_draft_tail", "ar30_rewrite_merge"])
def test_growing_texts_are_not_sorted(spark, sf, name):
    """A turn's partial texts add up to its square, so only the turns themselves may be moved, sorted or joined."""
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Sort ", "Window", "SortMergeJoin") if x in plan] and plan.count("Exchange") == 1


def test_events_come_from_turns_without_a_table_of_texts(spark, sf):
    """Places in a stream are counted by turns, so whole texts are neither written nor moved to number them."""
    from utterlake.plans import fixtures as fx
    from utterlake.session import used_scratch

    n = len(used_scratch())
    events = fx.live(spark, sf)
    assert len(used_scratch()) == n
    rows = sorted((r.stream, r.seq, r.k) for r in events.select("stream", "seq", "k").collect())
    assert rows and all(k == (b[2] + 1 if b[0] == s else 1) for b, (s, _, k) in zip([(None, 0, 0), *rows], rows))


def test_churn_moves_new_tokens_only(spark, sf):
    """Rows are compared within segments; what is written and moved afterwards are new tokens and the ends of segments, not whole texts."""
    from pyspark.sql import functions as F

    from utterlake.plans import fixtures as fx
    from utterlake.session import used_scratch

    n = len(used_scratch())
    entry.queries()["wn5_token_churn"](spark, sf)
    (path,) = used_scratch()[n:]
    turns = fx.turns(spark, sf)
    words = turns.agg(F.sum(F.size("w"))).first()[0]
    kept = spark.read.parquet(path)
    sizes = [F.sum(F.size(c)) for c in ("_new", "_first.c", "_first.h", "_last.c", "_last.h")]
    assert sum(x or 0 for x in kept.agg(*sizes).first()) < 6 * words


def test_churn_counts_on_across_segments(spark):
    from utterlake.operators.stabilize import token_churn

    rows = [(1, 0, 1, [], ["a"]), (1, 0, 2, ["a"], ["b"]), (1, 2, 9, ["a", "c"], ["b", "d"]), (1, 3, 10, [], []), (1, 4, 11, ["x"], ["y"]), (1, 4, 12, ["x"], ["y", "z"]), (2, 5, 3, [], ["q"])]
    d = spark.createDataFrame(rows, "stream long, segment long, seq long, c array<string>, h array<string>")
    got = sorted((r.stream, r.token_id, r.seq, r.part, r.pos, r.word) for r in token_churn(d, ["stream"], "segment", "seq", "c", "h").collect())
    want = [(1, "hypothesis", 0, "a"), (2, "confirmed", 0, "a"), (2, "hypothesis", 0, "b"), (9, "confirmed", 1, "c"), (9, "hypothesis", 1, "d")]
    want += [(11, "confirmed", 0, "x"), (11, "hypothesis", 0, "y"), (12, "hypothesis", 1, "z")]
    assert got == [(1, k + 1, *x) for k, x in enumerate(want)] + [(2, 1, 3, "hypothesis", 0, "q")]
