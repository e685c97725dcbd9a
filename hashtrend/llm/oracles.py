"""DuckDB statements of the queries that SQL can say on whole tables, each from its definition alone.

Byte windows, shingles, word windows and pairs are spelled out as rows; components are a recursive closure.  They take
time and space that grow with the square of a group of similar rows, so they are for small scale factors.
"""

from __future__ import annotations

import string

from hashtrend.llm.chat import END, LOSS_ROLE, PROBE, SEP, START

_FOLD = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP1 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM docs)
),
least AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
hit AS (SELECT doc_id, p FROM windows JOIN least USING (w) WHERE first_id < doc_id),
-- a hit starts a run of removed bytes unless the one before covers or touches its first byte
runs AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit)
),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
-- what is kept lies in front of every span and behind the last
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi, b - a AS removed FROM spans
  UNION ALL
  SELECT d.doc_id, coalesce(max(s.b), 0), any_value(length(d.h) // 2), 0 FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, any_value(length(d.h) // 2) AS n_bytes, sum(p.removed)::BIGINT AS n_removed, (count(*) - 1) AS n_spans,
  sha256(unhex(string_agg(substr(d.h, 2 * p.lo + 1, 2 * (p.hi - p.lo)), '' ORDER BY p.lo, p.hi))) AS kept_sha256
FROM docs d JOIN pieces p USING (doc_id) GROUP BY d.doc_id
"""

OP2 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
half AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
links AS (SELECT u, v FROM half UNION ALL SELECT v, u FROM half),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
component AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

OP5 = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM item_words WHERE len(w) > 0)
),
doc_words AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc_words, (SELECT DISTINCT n FROM windows))
),
found AS (SELECT doc_id, item_id, n, p FROM places JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc_words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
half AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
),
links AS (SELECT u, v FROM half UNION ALL SELECT v, u FROM half),
reach AS (SELECT doc_id AS u, doc_id AS v FROM doc_words UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
component AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM doc_words JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_ORDER = "ORDER BY turn NULLS FIRST, role, text"
OP11 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  -- an escaped "<", backslashes, "|" is one character longer
  sum(length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))
    + {len(START + SEP + END)})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

STATEMENTS = {
    "op1_suffix_dedup": OP1,
    "op2_embedding_dedup": OP2,
    "op5_decontamination": OP5,
    "op9_jaccard_join": OP9,
    "op11_chat_format": OP11,
}
