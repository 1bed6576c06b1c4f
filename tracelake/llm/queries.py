"""The queries of this subpackage, and SQL for those that DuckDB can check."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .embeddings import op11_embedding_dedup
from .exact_substrings import op8_exact_substrings
from .jaccard_join import op3_jaccard_join
from .licenses import op6_license_scan
from .merkle import op13_merkle_manifest
from .packing import op4_packing
from .passages import op10_fuzzy_passages
from .prefix_trie import op12_conversation_trie
from .quality_classifier import op2_quality_classifier
from .quality_rules import op1_quality_rules
from .tool_calls import op5_tool_calls
from .warc import op9_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op5_tool_calls": op5_tool_calls,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_exact_substrings": op8_exact_substrings,
    "op9_warc": op9_warc,
    "op10_fuzzy_passages": op10_fuzzy_passages,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: CRC-32 of an id's decimal digits, which DuckDB has no function for.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, k, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""",
    "op5_tool_calls": """
WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name, coalesce(text, '') AS text, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM conversations WHERE role IN ('user', 'system')),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM a),
r AS (SELECT conv_id, turn - 1 AS turn, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'),
j AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, name, text, level, content, CASE WHEN l.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END AS status FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn)
SELECT conv_id, 'call_' || CAST(turn AS VARCHAR) AS call_id, name, CAST(level AS BIGINT) AS level, status,
  coalesce(text != '' AND (name = 'ask' OR turn = 0), false) AS valid,
  concat_ws(';', CASE WHEN text = '' THEN '$.text: too short' END, CASE WHEN name = 'configure' AND turn > 0 THEN '$.turn: out of range' END) AS errors,
  sha256('{"arguments":' || coalesce('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || CAST(turn AS VARCHAR) || '}', 'null') || ',"id":"call_' || CAST(turn AS VARCHAR) || '","level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '"}') AS record_sha256
FROM j
""",
    "op8_exact_substrings": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, md5(substr(h, 2 * k + 1, 400)) AS g FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d WHERE length(h) >= 400)),
dup AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS p FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
isl AS (SELECT r, k, sum(CASE WHEN p IS NULL OR k - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS i FROM dup),
s AS (SELECT r, i, min(k) AS a, max(k) + 200 AS z FROM isl GROUP BY r, i),
g AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS e, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS head FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * e + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
v AS (SELECT *, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 6), lambda j: (strpos('0123456789abcdef', h[5 * i + j]) - 1) * CAST(power(16, 5 - j) AS BIGINT)))) AS q FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda c: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST(q[c // 4 + 1] AS BIGINT) // CAST(power(32, 3 - c % 4) AS BIGINT)) % 32 + 1 AS BIGINT)]), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != f THEN f END AS refers_to
FROM v
""",
    "op11_embedding_dedup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r != b.r AND list_cosine_similarity(a.e, b.e) >= 0.98),
w AS (SELECT r AS a, r AS b FROM v UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
c AS (SELECT w.a AS r, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.b GROUP BY w.a),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
""",
    "op12_conversation_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, md5(octet_length(encode(role)) || ':' || role || text) AS g, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x != '')) AS w FROM t),
o AS (SELECT conv_id, list({{'g': g, 'w': w}} ORDER BY turn NULLS FIRST, g) AS ts, {CRC32.format("conv_id")} % 4 AS h FROM g GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
m AS (SELECT conv_id, d, len(ts) AS n, array_to_string(list_transform(ts[1:d], lambda x: x.g), '') AS k, CASE WHEN d > 0 THEN ts[d].w ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT k, d, any_value(w) AS w, count(*) AS n_convs, min(conv_id) AS conv_id, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS e FROM m GROUP BY k, d),
c AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
s AS (SELECT substr(k, 1, 32 * a) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN f p ON f.d > 0 AND p.k = substr(f.k, 1, 32 * (f.d - 1))
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, coalesce({CRC32.format("doc_id")} % 7 = 0, false) AS bad FROM documents),
e AS (SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf, CASE WHEN bad THEN sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM e),
low AS (SELECT lang, 0 AS lvl, pos, size, leaf AS digest FROM l
  UNION ALL SELECT lang, lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY lang, lvl, pos // 2, size),
s AS (SELECT lang, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
top AS (SELECT 0 AS lvl, pos, size, subroot AS digest FROM s
  UNION ALL SELECT lvl + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY lvl, pos // 2, size),
node AS (SELECT s.pos AS k, lvl, low.pos, digest FROM low JOIN s ON low.lang IS NOT DISTINCT FROM s.lang WHERE low.size > 1
  UNION ALL SELECT s.pos, s.height + top.lvl, top.pos, top.digest FROM top, s WHERE top.size > 1),
leafs AS (SELECT row_number() OVER () AS r, l.doc_id, l.leaf, coalesce(changed, leaf) AS start, l.pos AS low_pos, s.pos AS k, s.height, s.subroot FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang),
levels AS (SELECT DISTINCT k, lvl FROM node),
walk AS (SELECT r, v.lvl, p.pos % 2 = 1 AS at_right, n.digest FROM leafs JOIN levels v USING (k), LATERAL (SELECT CASE WHEN v.lvl < height THEN low_pos >> v.lvl ELSE k >> (v.lvl - height) END AS pos) p LEFT JOIN node n ON n.k = leafs.k AND n.lvl = v.lvl AND n.pos = xor(p.pos, 1)),
fold AS (SELECT r, 0 AS lvl, start AS digest FROM leafs
  UNION ALL SELECT f.r, f.lvl + 1, sha256(CASE WHEN w.digest IS NULL THEN f.digest WHEN at_right THEN w.digest || f.digest ELSE f.digest || w.digest END) FROM fold f JOIN walk w ON w.r = f.r AND w.lvl = f.lvl),
ends AS (SELECT r, arg_max(digest, lvl) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(digest, '' ORDER BY lvl) AS p FROM walk GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE size = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM top WHERE size = 1) AS verified
FROM leafs LEFT JOIN proofs USING (r) JOIN ends USING (r)
""",
}
