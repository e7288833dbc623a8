"""DuckDB text of the input views; utterlake.plans.fixtures holds the Spark side of each."""

from __future__ import annotations

from utterlake.functions.text import WHITE

VIEWS: dict[str, str] = {}
REUSED = {"v_wer", "v_state", "v_vad", "v_live"}


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{WHITE}]+'), lambda w: w <> '')"


def strip_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{WHITE}]+', ''), '[{WHITE}]+$', '')"


def norm_sql(text: str) -> str:
    kept = f"regexp_replace(lower({text}), '[^a-z0-9''\\s]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


VIEWS["v_conv"] = f"""
SELECT conv_id, turn, words, coalesce(lag(words) OVER (PARTITION BY conv_id ORDER BY turn), CAST([] AS VARCHAR[])) AS prev_words
FROM (SELECT conv_id, turn, {words_sql('text')} AS words FROM conversations)
"""

VIEWS["v_ref"] = f"""
SELECT conv_id, turn, conv_id || '-' || turn AS id,
       CASE WHEN conv_id % 19 = 0 AND turn = 0 THEN '' ELSE {norm_sql('text')} END AS text
FROM conversations
"""

VIEWS["v_hyp"] = """
SELECT id, conv_id, turn,
       array_to_string(flatten(list_transform(w, lambda x, i:
         CASE WHEN i % 7 = 0 THEN CAST([] AS VARCHAR[])
              WHEN i % 13 = 0 THEN [CASE WHEN i % 11 = 0 THEN 'uh' ELSE x END, CASE WHEN i % 11 = 0 THEN 'uh' ELSE x END]
              ELSE [CASE WHEN i % 11 = 0 THEN 'uh' ELSE x END] END)), ' ') AS hyp_a,
       array_to_string(list_filter(w, lambda x, i: i % 5 <> 0), ' ') AS hyp_b,
       n / 2.5 AS audio_sec,
       n / 2.5 / (4 + conv_id % 5) AS infer_a,
       n / 2.5 / (3 + turn % 3) AS infer_b
FROM (SELECT id, conv_id, turn, w, CAST(len(w) AS DOUBLE) AS n
      FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM v_ref))
WHERE conv_id % 23 <> 0
"""

VIEWS["v_part"] = f"""
SELECT conv_id AS stream, turn AS segment, turn * 4294967296 + k AS seq,
       CASE WHEN k > n THEN 'flush' ELSE 'partial' END AS action,
       CASE WHEN k > n THEN CAST([] AS VARCHAR[])
            WHEN k % 2 = 1 THEN list_concat(w[1:least(3 * k, len(w)) - 1], [left(w[least(3 * k, len(w))], 3)])
            ELSE w[1:3 * k] END AS words
FROM (SELECT conv_id, turn, w, CAST(ceil(len(w) / 3.0) AS BIGINT) AS n,
             unnest(range(1, CAST(ceil(len(w) / 3.0) AS BIGINT) + 2)) AS k
      FROM (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations))
"""

VIEWS["v_en"] = """
SELECT user_id AS stream, event_id AS seq, 20.0::DOUBLE * log10(greatest(value / 500.0::DOUBLE, 1e-7::DOUBLE)) AS dbfs, 320 AS frame_ms
FROM events
"""

VIEWS["v_ev"] = """
SELECT user_id AS stream, event_id AS seq, 1000 + 500 * (event_id % 7) AS n_samples,
       epoch_us(ts) / 1000000.0::DOUBLE AS received_at,
       CAST(sum(1000 + 500 * (event_id % 7)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS cursor,
       epoch_us(ts) / 1000000.0::DOUBLE + value / 1000.0::DOUBLE AS ready_at, value
FROM events
"""

VIEWS["v_probe"] = """
SELECT stream, seq, 'near' AS kind, greatest(1, cursor - 250) AS probe, ready_at FROM v_ev
UNION ALL
SELECT stream, seq, 'far' AS kind, cursor + 100000 AS probe, ready_at FROM v_ev
"""

VIEWS["v_back"] = """
SELECT user_id AS stream, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour,
       count(*) AS queued, min(minute(ts)) / 60.0::DOUBLE * 2 AS elapsed,
       count(DISTINCT event_type) - 1 AS words
FROM events GROUP BY 1, 2
"""

VIEWS["v_lines"] = r"""
SELECT conv_id AS file, turn AS ordinal, 3.5::DOUBLE * turn AS start_sec, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t,
    (conv_id + turn) % 6 AS form FROM conversations
"""

VIEWS["v_trace"] = """
SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id, 'a' AS side,
       event_type AS k1, CAST(floor(value) AS BIGINT) AS k2 FROM events
UNION ALL
SELECT trace, idx, event_id, 'b' AS side, k1, k2 + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS k2
FROM (SELECT user_id AS trace, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx,
             count(*) OVER (PARTITION BY user_id) AS n, event_type AS k1, CAST(floor(value) AS BIGINT) AS k2 FROM events)
WHERE NOT (trace % 3 = 0 AND idx = n - 1)
"""

VIEWS["v_man"] = """
SELECT o_orderpriority AS dataset, o_orderstatus AS profile, 'run-' || o_orderkey AS run_name,
       CASE WHEN o_custkey % 10 = 0 THEN 'failed' ELSE 'ok' END AS status,
       o_orderkey % 50 = 0 AS broken, s.wer, s.rtf, s.n
FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_discount) AS wer, avg(l_quantity) / 100.0::DOUBLE AS rtf, count(*) AS n
                       FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey
"""

VIEWS["v_sweep"] = """
SELECT l_linenumber / 4.0::DOUBLE AS stride, l_suppkey % 3 AS repetition,
       avg(l_quantity) / 10 AS infer_rtfx, avg(l_extendedprice) / 100 AS primary_ms,
       quantile_cont(CAST(l_extendedprice AS DOUBLE) / 100, 0.95) AS p95_ms,
       CAST(sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) % 2 AS BIGINT) AS corrections,
       CASE WHEN l_linenumber = 3 AND l_suppkey % 3 = 1 THEN 'other' ELSE 'same' END AS text
FROM lineitem GROUP BY l_linenumber, l_suppkey % 3
"""

VIEWS["v_ops"] = """
SELECT event_id, event_type AS op,
       CASE user_id % 3 WHEN 0 THEN 'CPU' WHEN 1 THEN 'GPU' ELSE 'NE' END AS device,
       CASE user_id % 3 WHEN 0 THEN ['CPU'] WHEN 1 THEN ['CPU', 'GPU'] ELSE ['CPU', 'GPU', 'NE'] END AS support,
       value AS cost
FROM events
"""

VIEWS["v_prof"] = """
SELECT user_id AS stream, event_id AS seq, value * 0.1::DOUBLE AS feature_ms, value * 0.2::DOUBLE AS prepare_ms,
       value * 0.4::DOUBLE AS predict_ms, value * 0.2::DOUBLE AS decode_ms, value * 0.1::DOUBLE AS merge_ms,
       value * 1.05::DOUBLE AS total_ms, event_id % 7 + 1 AS encoder_windows, event_id % 3 AS encoder_reused, event_id % 5 AS encoder_computed,
       event_id % 13 AS reuse_steps, event_id % 17 AS compute_steps, event_id % 6 AS decoder_windows, event_id % 2 AS resumed_windows,
       event_id % 9 AS resumed_tokens, event_id % 19 AS predict_calls, event_id % 8 AS advance_calls, event_id % 11 AS emitted, event_id % 5 AS blanks,
       event_id % 100 + 1 AS requested_frames, event_id % 90 AS copied_frames,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 0.25::DOUBLE AS cursor_sec
FROM events
"""

VIEWS["v_vocab"] = f"""
SELECT word, '▁' || word AS piece, row_number() OVER (ORDER BY word COLLATE "C") - 1 AS id
FROM (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM conversations)
"""

VIEWS["v_word"] = f"""
SELECT conv_id AS stream, turn AS seq, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word
FROM (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations)
"""

VIEWS["v_ids"] = """
SELECT stream, seq, list(id ORDER BY pos) AS tokens FROM v_word JOIN v_vocab USING (word) GROUP BY 1, 2
"""

VIEWS["v_tok"] = """
SELECT stream, seq, 'turn' AS kind, tokens, next_tokens
FROM (SELECT stream, seq, tokens, coalesce(lead(tokens) OVER (PARTITION BY stream ORDER BY seq), CAST([] AS BIGINT[])) AS next_tokens FROM v_ids)
UNION ALL
SELECT stream, seq, 'tail' AS kind, tokens, list_concat(tokens[greatest(len(tokens) - 11, 1):len(tokens)], list_transform(range(4), lambda i: 1000000 + i)) AS next_tokens
FROM v_ids
"""

VIEWS["v_logit"] = """
SELECT vec_id // 10 AS utt, vec_id % 10 AS step, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS scores FROM embeddings
"""

VIEWS["v_sig"] = """
SELECT vec_id AS utt, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS samples FROM embeddings
"""

VIEWS["v_sig2"] = """
SELECT a.utt // 2 AS utt, a.samples AS ch0, b.samples AS ch1 FROM v_sig a JOIN v_sig b ON b.utt = a.utt + 1 WHERE a.utt % 2 = 0
"""

VIEWS["v_seg"] = f"""
SELECT doc_id, s // 40 AS seg, w[s + 1:s + 50] AS words
FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 40)) AS s
      FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents))
WHERE len(w) > 0 AND (s = 0 OR s + 10 < len(w))
"""

VIEWS["v_len"] = "SELECT doc_id, n_chars AS total FROM documents"

VIEWS["v_pay"] = """
SELECT stream, segment, list(CASE WHEN k % 4 = 0 THEN '  ' ELSE array_to_string(words, ' ') END ORDER BY seq) AS results,
       list(k * 0.32::DOUBLE ORDER BY seq)[1:CASE WHEN stream % 2 = 0 THEN count(*) - 1 ELSE count(*) END] AS cursors,
       list(CASE WHEN k % 2 = 0 THEN [k * 0.32::DOUBLE, k * 0.32::DOUBLE + 0.1::DOUBLE] ELSE [k * 0.32::DOUBLE] END ORDER BY seq)[1:count(*) // 2] AS stamps
FROM (SELECT *, seq - segment * 4294967296 AS k FROM v_part WHERE action = 'partial')
GROUP BY stream, segment
"""

VIEWS["v_pair"] = """
SELECT id, h.conv_id, h.turn, s.sys, list_filter(string_split(r.text, ' '), lambda w: w <> '') AS r,
       list_filter(string_split(CASE s.sys WHEN 'a' THEN hyp_a ELSE hyp_b END, ' '), lambda w: w <> '') AS h
FROM v_ref r JOIN v_hyp h USING (id), (VALUES ('a'), ('b')) s(sys)
"""


def _dp_step() -> str:
    """One row of the edit table: costs without in-row moves, then a prefix minimum by doubling."""
    sub = """SELECT id, sys, i + 1 AS i, r, h, list_transform(d, lambda x, j: CASE WHEN j = 1 THEN x + 1
        ELSE least(x + 1, d[j - 1] + CASE WHEN r[i + 1] = h[j - 1] THEN 0 ELSE 1 END) - (j - 1) END) AS u
      FROM v_dp WHERE i < len(r)"""
    for k in range(10):
        s = 2**k
        sub = f"""SELECT id, sys, i, r, h, list_transform(u, lambda x, j: CASE WHEN j > {s} THEN least(x, u[j - {s}]) ELSE x END) AS u
          FROM ({sub})"""
    return f"SELECT id, sys, i, r, h, list_transform(u, lambda x, j: x + (j - 1)) FROM ({sub})"


VIEWS["v_dp"] = f"""
SELECT id, sys, CAST(0 AS BIGINT) AS i, r, h, range(0, len(h) + 1) AS d FROM v_pair UNION ALL {_dp_step()}
"""

VIEWS["v_wer"] = """
SELECT p.id, p.conv_id, p.turn, p.sys, len(p.r) AS n_ref, len(p.h) AS n_hyp, x.d[len(x.d)] AS dist,
       audio_sec, CASE p.sys WHEN 'a' THEN infer_a ELSE infer_b END AS infer_sec
FROM v_pair p JOIN v_dp x ON x.id = p.id AND x.sys = p.sys AND x.i = len(x.r) JOIN v_hyp h ON h.id = p.id
"""


def lcp_sql(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    miss = f"list_filter(range(1, {n} + 1), lambda i: {a}[i] <> {b}[i])"
    return f"coalesce(list_min({miss}) - 1, {n})"


def overlap_sql(a: str, b: str, limit: int) -> str:
    fits = f"list_filter(range(1, least({limit}, len({a}), len({b})) + 1), lambda k: {a}[len({a}) - k + 1:] = {b}[1:k])"
    return f"coalesce(list_max({fits}), 0)"


def draft_tail_sql(c: str, d: str) -> str:
    cut = f"greatest({lcp_sql(c, d)}, {overlap_sql(c, d, 64)})"
    return f"CASE WHEN len({c}) = 0 OR len({d}) = 0 THEN {d} ELSE {d}[{cut} + 1:] END"


VIEWS["v_state"] = f"""
SELECT stream, segment, seq, action, words, confirmed, CASE WHEN action = 'flush' THEN CAST([] AS VARCHAR[]) ELSE {draft_tail_sql('confirmed', 'words')} END AS hypothesis
FROM (SELECT *, CASE WHEN len(lists) < 2 THEN CAST([] AS VARCHAR[]) WHEN action = 'flush' THEN lists[1] ELSE lists[1][1:{lcp_sql('lists[1]', 'lists[2]')}] END AS confirmed
  FROM (SELECT *, list(words) OVER (PARTITION BY stream, segment ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS lists FROM v_part))
"""

VIEWS["v_vad"] = """
SELECT stream, seq, dbfs, coalesce(last_value(event IGNORE NULLS) OVER w, false) AS speech
FROM (SELECT *, CASE WHEN hot >= 640 THEN true WHEN quiet >= 640 THEN false END AS event
  FROM (SELECT stream, seq, dbfs, sum(CASE WHEN dbfs >= -20 THEN frame_ms ELSE 0 END) OVER (PARTITION BY stream, hot_island ORDER BY seq) AS hot,
               sum(CASE WHEN dbfs <= -30 THEN frame_ms ELSE 0 END) OVER (PARTITION BY stream, quiet_island ORDER BY seq) AS quiet
    FROM (SELECT *, sum(CASE WHEN dbfs >= -20 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq) AS hot_island,
                 sum(CASE WHEN dbfs <= -30 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq) AS quiet_island FROM v_en)))
WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

VIEWS["v_live"] = """
SELECT stream, seq, k, action = 'flush' AS is_flush, action <> 'flush' AS is_speech, confirmed, hypothesis, concat_ws(' ', nullif(confirmed, ''), nullif(hypothesis, '')) AS merged,
       k * 5120 - (k % 3) * 2000 AS cursor, k * 0.32::DOUBLE + 0.05::DOUBLE + 0.02::DOUBLE * (k % 7) + 0.3::DOUBLE * (k % 41) AS ready_at
FROM (SELECT stream, seq, action, array_to_string(confirmed, ' ') AS confirmed, array_to_string(hypothesis, ' ') AS hypothesis,
             row_number() OVER (PARTITION BY stream ORDER BY seq) AS k, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS left_over FROM v_state)
WHERE NOT (stream % 4 = 0 AND left_over = 1)
"""

VIEWS["v_mark"] = """
SELECT stream, k * 5120 AS cursor, k * 0.32::DOUBLE + 0.01::DOUBLE * (k % 5) AS received_at
FROM (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) AS k FROM v_state)
"""

VIEWS["v_step"] = """
SELECT l.*, m.received_at AS ingress_at,
       coalesce(lag(is_speech) OVER w, false) AS prev_speech, coalesce(lag(confirmed) OVER w, '') AS prev_confirmed,
       coalesce(lag(hypothesis) OVER w, '') AS prev_hypothesis, coalesce(lag(l.merged) OVER w, '') AS prev_merged,
       max(CASE WHEN is_flush THEN seq END) OVER (PARTITION BY l.stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flushed_before
FROM v_live l ASOF LEFT JOIN v_mark m ON m.stream = l.stream AND greatest(1, l.cursor) <= m.cursor
WINDOW w AS (PARTITION BY l.stream ORDER BY seq)
"""

VIEWS["v_spoken"] = """
SELECT s.*, o.start_seq, o.segment_no, o.start_ingress, o.base_confirmed, o.base_hypothesis, o.base_merged
FROM v_step s ASOF JOIN (SELECT stream, seq AS start_seq, row_number() OVER (PARTITION BY stream ORDER BY seq) AS segment_no, ingress_at AS start_ingress,
    prev_confirmed AS base_confirmed, prev_hypothesis AS base_hypothesis, prev_merged AS base_merged FROM v_step WHERE is_speech AND NOT prev_speech) o
  ON o.stream = s.stream AND s.seq >= o.start_seq
WHERE flushed_before IS NULL OR flushed_before < o.start_seq
"""

VIEWS["v_first"] = """
SELECT stream, segment_no, min(start_ingress) AS start_ingress,
       arg_min(ready_at, seq) FILTER (WHERE is_speech AND hypothesis <> base_hypothesis) AS draft_at,
       arg_min(ready_at, seq) FILTER (WHERE is_speech AND merged <> base_merged) AS merged_at,
       arg_min(ready_at, seq) FILTER (WHERE is_flush AND confirmed <> base_confirmed) AS final_at,
       max(ready_at) AS last_at, max(CASE WHEN is_flush THEN 1 ELSE 0 END) AS flushed, arg_max(merged, seq) AS last_merged
FROM v_spoken GROUP BY stream, segment_no
"""

VIEWS["v_pending"] = """
SELECT stream, segment_no, greatest(0, (last_at - start_ingress) * 1000) AS pending_ms, greatest(0, (last_at - arrived) * 1000) AS pending_ready_ms
FROM v_first JOIN (SELECT stream, max(segment_no) AS segment_no FROM (SELECT stream, count(*) AS segment_no FROM v_step WHERE is_speech AND NOT prev_speech GROUP BY stream) GROUP BY stream) USING (stream, segment_no)
  JOIN (SELECT stream, arg_max(received_at, cursor) AS arrived FROM v_mark GROUP BY stream) USING (stream)
WHERE flushed = 0 AND trim(last_merged) <> '' AND start_ingress IS NOT NULL
"""

VIEWS["v_series"] = """
SELECT 'draft_first_token' AS series, greatest(0, (draft_at - start_ingress) * 1000) AS ms FROM v_first WHERE draft_at IS NOT NULL
UNION ALL SELECT 'merged_first_token', greatest(0, (merged_at - start_ingress) * 1000) FROM v_first WHERE merged_at IS NOT NULL
UNION ALL SELECT 'final_confirmed', greatest(0, (final_at - start_ingress) * 1000) FROM v_first WHERE final_at IS NOT NULL
UNION ALL SELECT 'final_confirmed', pending_ms FROM v_pending
UNION ALL SELECT 'final_ready', greatest(0, (ready_at - ingress_at) * 1000) FROM v_spoken WHERE is_flush AND confirmed <> prev_confirmed AND ingress_at IS NOT NULL
UNION ALL SELECT 'final_ready', pending_ready_ms FROM v_pending
UNION ALL SELECT 'draft_ready', greatest(0, (ready_at - ingress_at) * 1000) FROM v_step WHERE hypothesis <> prev_hypothesis AND ingress_at IS NOT NULL
"""
