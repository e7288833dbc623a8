"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Words of each document with the last repeated window that starts at or before them.
OP1 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, w[i] AS item, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS k FROM p),
n AS (SELECT *, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS hit FROM k),
g AS (SELECT *, coalesce(i - max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 35, false) AS gone FROM n),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM g),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans,
  coalesce(string_agg(item, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM w LEFT JOIN t USING (doc_id)
"""

#: The same over bytes, as pairs of hexadecimal digits.
OP3 = """
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM w),
k AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS item, CASE WHEN 2 * i + 400 <= length(x) THEN md5(substr(x, 2 * i + 1, 400)) END AS k FROM p),
n AS (SELECT *, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS hit FROM k),
g AS (SELECT *, coalesce(i - max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 200, false) AS gone FROM n),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM g),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans,
  coalesce(string_agg(item, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""

#: All pairs that share a shingle; classes as sets of what can be reached.
OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE o.n >= 0.8 * (x.n + y.n - o.n)
  UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b USING (text)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a
"""

#: Failed filters of each document, then every order from the failures alone.
OP12 = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}} AS fails FROM t LEFT JOIN l USING (doc_id)),
f AS (SELECT part, good, toxic, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END)
  || (CASE WHEN fails.D THEN 'D' ELSE '' END) || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS bad FROM d),
g AS (SELECT part, good, toxic, bad, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
k AS (SELECT *, filter_order[step:step] AS own, left(filter_order, step - 1) AS before FROM s),
r AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (WHERE translate(bad, before || own, '') = bad), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE contains(bad, own) AND translate(bad, before, '') = bad), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE contains(bad, own) AND translate(bad, before, '') <> bad), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE bad = own), 0) AS unique_fails,
  coalesce(sum(n * good) FILTER (WHERE contains(bad, own) AND translate(bad, before, '') = bad), 0) AS good_lost,
  coalesce(sum(n * toxic) FILTER (WHERE contains(bad, own) AND translate(bad, before, '') = bad), 0) AS toxic_lost
  FROM g, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

#: All phrases of one to three words, counted at once.
OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, w, i, unnest([1, 2, 3]) AS k FROM i),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM s WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
v AS (SELECT u.lang, u.phrase, u.k, a, cut, l.f AS l, r.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM u JOIN g l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN g r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
y AS (SELECT lang, phrase, max(a) AS around FROM x GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN y USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000
"""
