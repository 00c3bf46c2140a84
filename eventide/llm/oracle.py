"""DuckDB twins of the queries that SQL can express."""

ORACLE = {}

ORACLE["op3_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

ORACLE["op4_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w - 1 AS idx FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
q AS (SELECT *, NOT coalesce(
    (before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'), false) AS bad FROM p),
g AS (SELECT conv_id, count(*) AS n_turns, min(idx) FILTER (WHERE bad) AS first_bad,
  arg_max(role, idx) AS last_role,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx) AS turns,
  coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(4 + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 2
    + length(text) + len(regexp_extract_all(text, '[\\#<]')) + 8) AS size
  FROM q GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  size AS formatted_chars, first_bad IS NULL AND last_role = 'assistant' AS valid,
  CASE WHEN first_bad IS NOT NULL THEN first_bad WHEN last_role <> 'assistant' THEN n_turns END AS bad_turn
FROM g
"""

ORACLE["op12_filter_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
t AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(words) < 100)::INT
    + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 10 * length(w.text))::INT
    + 8 * regexp_matches(w.text, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > t.first_id, false)::INT AS mask
  FROM w JOIN t USING (text) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
c AS (SELECT i::INT AS i, chr(65 + i::INT) AS letter, (1 << i::INT) AS bit FROM range(5) r(i)),
o AS (SELECT '' AS filter_order, 0 AS used UNION ALL
  SELECT filter_order || letter, used + bit FROM o, c WHERE used & bit = 0),
s AS (SELECT filter_order, k::INT AS step, ascii(filter_order[k::INT]) - 65 AS i FROM o, range(1, 6) r(k) WHERE length(filter_order) = 5),
b AS (SELECT s.filter_order, s.step, 1 << s.i AS bit, coalesce(sum(1 << p.i), 0)::INT AS earlier
  FROM s LEFT JOIN s p ON p.filter_order = s.filter_order AND p.step < s.step GROUP BY s.filter_order, s.step, s.i),
g AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE mask & (earlier | bit) = 0) AS kept,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS toxic_lost
  FROM m, b GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM g
"""
