"""The registry: names, oracles on small data, and plan shapes."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, cell, key

NATIVE_EXCEPT = ("ar12", "ag21", "uf", "sg6", "sg7", "sg8", "st")
CHECKED = (
    "pj1_normalize_basic pj11_stride_id ar6_append_with_overlap ar8_window_merge ar13_fold_merge jn3_multiset_overlap_join "
    "jn6_forward_asof_join jn8_manifest_summaries jn11_containment_join ag1_word_edit_distance ag7_percentile_linear "
    "ag13_sweep_aggregate ag16_placement_rollup ag18_realtime_summary wn1_local_agreement wn4_revision_counter wn6_vad_hysteresis "
    "wn12_final_confirmed_latency wn15_rolling_last_n wn17_first_divergence wn18_cumulative_budget_pick tk2_frontier_recommendation "
    "sg7_mel_project sc1_scan_utterances st2_sliding_windows st4_stabilizer_state st8_ewma_adaptive_increment uf6_plan_segments_udtf "
    "st5_session_windows st10_end_of_stream st11_streaming_latency st12_batch_trace uf4_swappable_detector uf5_ordered_fold pj4_tokenize_ws "
    "sc4_scan_speaker_lines tk5_keep_best_top_n wn14_transcript_cursor wn19_stagnation_run"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_registry_names():
    qs, os_ = entry.queries(), entry.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 169


@pytest.mark.parametrize("name", CHECKED)
def test_against_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = sorted((tuple(cell(v) for v in r) for r in df.collect()), key=key)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = sorted((tuple(cell(r[i]) for i in at) for r in cur.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.sys for r in rows} == {"a", "b"}


# One-row sides are joined by broadcast here.
ONE_ROW = {"ag18", "ag19", "ag7", "jn9", "ag13", "tk2", "sk2", "sk6", "wn18"}


@pytest.mark.parametrize("name", ["jn3_multiset_overlap_join", "jn5_neighbourhood_range_join", "jn6_forward_asof_join", "jn11_containment_join", "wn6_vad_hysteresis", "wn17_first_divergence", "ag1_word_edit_distance"])
def test_plans_have_no_pairwise_join_or_python(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan, (name, bad)


def test_scan_reads_only_needed_columns(spark, sf):
    plan = entry.queries()["tk3_top_groups"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
