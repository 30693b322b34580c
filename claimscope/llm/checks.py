"""DuckDB SQL for the operators whose results SQL can express."""

# Slot by slot, without the period: each step picks the released block with the earliest deadline.
PFAIR = """
WITH RECURSIVE n AS (SELECT COALESCE('=' || source, '') name, COUNT(*) n FROM documents GROUP BY 1),
s AS (SELECT name, (n + 15) // 16 blocks, GREATEST(1, CAST(ROUND(1000 * SQRT(n) / (SELECT SUM(SQRT(n)) FROM n)) AS BIGINT)) weight FROM n),
l AS (SELECT LIST(name ORDER BY name) names, LIST(blocks ORDER BY name) blocks, LIST(weight ORDER BY name) weights, COUNT(*) size FROM s),
state AS (SELECT 0::BIGINT slot, 0::BIGINT started, 0::BIGINT phase, LIST_TRANSFORM(blocks, LAMBDA x: 0::BIGINT) done, LIST_TRANSFORM(blocks, LAMBDA x: 0::BIGINT) got,
  LIST_SUM(weights)::BIGINT period, NULL::BIGINT chosen, NULL::BIGINT block, NULL::BIGINT release, NULL::BIGINT deadline FROM l
 UNION ALL
 SELECT slot + 1, CASE WHEN ended THEN slot + 1 ELSE started END, CASE WHEN ended THEN phase + 1 ELSE phase END, next_done,
  CASE WHEN ended THEN LIST_TRANSFORM(got, LAMBDA x: 0::BIGINT) ELSE LIST_TRANSFORM(got, LAMBDA x, i: CASE WHEN i = c THEN x + 1 ELSE x END) END,
  CASE WHEN ended THEN LIST_SUM(LIST_TRANSFORM(weights, LAMBDA w, i: CASE WHEN next_done[i] < blocks[i] THEN w ELSE 0 END))::BIGINT ELSE period END,
  c, done[c], started + got[c] * period // weights[c], started + ((got[c] + 1) * period + weights[c] - 1) // weights[c]
 FROM (SELECT *, next_done[c] = blocks[c] ended FROM (SELECT *, LIST_TRANSFORM(done, LAMBDA x, i: CASE WHEN i = c THEN x + 1 ELSE x END) next_done FROM (
  SELECT state.* EXCLUDE (chosen, block, release, deadline), l.*, LIST_MIN(LIST_TRANSFORM(weights, LAMBDA w, i: CASE WHEN done[i] < blocks[i] AND got[i] * period // w <= slot - started
   THEN (((got[i] + 1) * period + w - 1) // w) * 100000 + i END)) % 100000 c FROM state, l)) WHERE c IS NOT NULL)),
places AS (SELECT l.names[chosen] name, block, slot - 1 slot, release, deadline,
  MAX(phase) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) phase FROM state, l),
d AS (SELECT doc_id, source, COALESCE('=' || source, '') name, ROW_NUMBER() OVER (PARTITION BY source ORDER BY MD5(doc_id::VARCHAR)) - 1 i FROM documents)
SELECT doc_id, source, i // 16 mix_block, CAST(phase AS INTEGER) mix_phase, release mix_release, deadline mix_deadline, slot mix_slot, i % 16 mix_row
FROM d JOIN places ON places.name = d.name AND block = i // 16"""

_DIGITS = " || ".join(
    f"SUBSTR('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || SUBSTR(s, {1 + 5 * group}, 5))::BIGINT >> {shift}) & 31 AS INTEGER), 1)"
    for group in range(8) for shift in (15, 10, 5, 0)
)
WARC = f"""
WITH d AS (SELECT page_id, STRLEN(COALESCE(html, '')) payload_bytes, SHA1(COALESCE(html, '')) s FROM pages),
w AS (SELECT s, MAX(page_id) first FROM d GROUP BY s)
SELECT page_id, payload_bytes, {_DIGITS} payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type,
 CASE WHEN page_id <> first THEN first END refers_to, TRUE verified FROM d JOIN w USING (s)"""

TOP_K = """
WITH v AS (SELECT vec_id, LIST_TRANSFORM(embedding, LAMBDA x: FLOOR(256 * x::DOUBLE)) e FROM embeddings
 WHERE vec_id IS NOT NULL AND LEN(embedding) > 0 AND LEN(LIST_FILTER(embedding, LAMBDA x: x IS NOT NULL AND ISFINITE(x))) = LEN(embedding)),
p AS (SELECT q.vec_id query_id, c.vec_id, CAST(LIST_DOT_PRODUCT(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND LEN(q.e) = LEN(c.e) WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) "rank", vec_id, score FROM p) WHERE "rank" <= 5"""

# For conversations in which no turn is a tool message of its own, as in the test tables.
TOOL_CALLS = """
WITH t AS (SELECT conv_id, turn, role, COALESCE(text, '') text FROM conversations WHERE turn IS NOT NULL),
f AS (SELECT conv_id, MIN(turn) first FROM t WHERE role = 'user' GROUP BY conv_id),
c AS (SELECT t.conv_id, 'turn-' || turn call_id, CASE WHEN turn > first THEN 1 ELSE 0 END::BIGINT level, turn, 'reply' name, COUNT(*) OVER (PARTITION BY t.conv_id, turn) same,
  '{' || CASE WHEN turn > first THEN '"context":"$ref:turn-' || first || '",' ELSE '' END || '"prompt":' || TO_JSON(text)::VARCHAR || ',"turn":' || turn || '}' arguments
 FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id WHERE role = 'user'),
r AS (SELECT conv_id, 'turn-' || (turn - 1) call_id, turn, MIN(text) content, COUNT(*) n_results FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
a AS (SELECT c.conv_id, c.call_id, level, c.turn, name, COALESCE(n_results, 0) n_results, arguments, content,
  CASE WHEN same > 1 THEN 'duplicate_id' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END status
 FROM c LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id
 UNION ALL SELECT r.conv_id, r.call_id, NULL, r.turn, NULL, n_results, 'null', content, 'orphan_result'
 FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id))
SELECT conv_id, call_id, level, turn, 0::BIGINT "index", name, status, '' errors, n_results, '{"arguments":' || arguments || ',"call_id":"' || call_id || '","conv_id":' ||
 COALESCE(conv_id::VARCHAR, 'null') || ',"errors":[],"level":' || COALESCE(level::VARCHAR, 'null') || ',"name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"reply"' END ||
 ',"result":' || COALESCE(TO_JSON(content)::VARCHAR, 'null') || ',"status":"' || status || '","turn":' || turn || '}' json FROM a"""

_TERMS = r"""REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
RANKED = f"""
WITH d AS (SELECT doc_id, ROW_NUMBER() OVER () doc, terms, LEN(terms) n FROM (SELECT doc_id, {_TERMS} terms FROM documents) WHERE LEN(terms) > 0),
s AS (SELECT COUNT(*) n_docs, SUM(n)::BIGINT total FROM d),
q AS (SELECT item_id, text, term, COUNT(*) asked FROM (SELECT item_id, text, UNNEST({_TERMS}) term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (SELECT doc, term, COUNT(*) tf FROM (SELECT doc, UNNEST(terms) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, FLOOR(1000 * LN((2 * n_docs + 2) / (2 * df + 1)))::BIGINT w FROM (SELECT term, COUNT(*) df FROM tf GROUP BY term), s),
x AS (SELECT item_id, text, doc, SUM(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT score
 FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc), s GROUP BY ALL)
SELECT item_id, "rank", doc_id, score FROM (SELECT item_id, doc_id, score, CAST(ROW_NUMBER() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) "rank"
 FROM x JOIN d USING (doc) WHERE score > 0) WHERE "rank" <= 10"""

CHECKS = {"op1_pfair_mix": PFAIR, "op5_warc": WARC, "op8_kdtree": TOP_K, "op9_tool_calls": TOOL_CALLS, "op12_balltree": RANKED}
