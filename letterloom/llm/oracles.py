"""The registered queries that SQL can express, as DuckDB runs them on the same tables."""

from __future__ import annotations

#: Components by spreading smaller ids along ``links`` (a, b in both directions) from every node of ``nodes``.
_REACHED = """reached(node, part) AS (SELECT node, node FROM nodes UNION SELECT b, part FROM reached JOIN links ON node = a WHERE part < b)"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS node, embedding::DOUBLE[] AS e FROM embeddings), nodes AS (SELECT node FROM v),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.node AS a, y.node AS b FROM good x JOIN good y ON len(x.e) = len(y.e) AND x.node <> y.node WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACHED}, counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT node, min(part) AS part FROM reached GROUP BY node)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, part AS component_id, node = part AS kept FROM least LEFT JOIN counted ON a = node"""

CHAT_FORMAT = r"""WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS probe(n, r)),
marked AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS t, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) AS r FROM told)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + r + 2 + t + 9)::BIGINT AS formatted_chars FROM marked GROUP BY conv_id"""

REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data FROM documents), sized AS (SELECT *, octet_length(data) AS n FROM d),
starts AS (SELECT r, unnest(range(1, n - 398)) AS p FROM sized WHERE n >= 400),
windows AS (SELECT r, p, md5(data[p:p + 399]) AS w FROM starts JOIN sized USING (r)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY w) AS times FROM windows) WHERE times > 1),
opened AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS fresh FROM twice),
numbered AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM opened),
runs AS (SELECT r, k, min(p) AS a, max(p) + 399 AS b FROM numbered GROUP BY r, k),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS low, a - 1 AS high FROM runs UNION ALL SELECT r, coalesce(max(b), 0) + 1, any_value(n) FROM sized LEFT JOIN runs USING (r) GROUP BY r),
kept AS (SELECT r, coalesce(string_agg(hex(data[low:high]), '' ORDER BY low) FILTER (low <= high), '') AS k FROM gaps JOIN sized USING (r) GROUP BY r),
removed AS (SELECT r, sum(b - a + 1) AS bytes, count(*) AS runs FROM runs GROUP BY r),
whole AS (SELECT r, array_to_string(list_filter(regexp_extract_all(k, '[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].|..'),
  lambda c: length(c) > 2 OR c < '8'), '') AS t FROM kept)
SELECT doc_id, n AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256, decode(unhex(t)) AS text
FROM sized JOIN kept USING (r) JOIN whole USING (r) LEFT JOIN removed USING (r)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

MINHASH = rf"""WITH RECURSIVE told AS (SELECT doc_id AS node, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents), nodes AS (SELECT node FROM told),
each AS (SELECT node, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM told WHERE len(w) > 0), sets AS (SELECT DISTINCT node, array_to_string(w[p:p + 2], ' ') AS s FROM each),
sizes AS (SELECT node, count(*) AS n FROM sets GROUP BY node),
shared AS (SELECT x.node AS a, y.node AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.node <> y.node GROUP BY x.node, y.node),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
{_REACHED}, least AS (SELECT node, min(part) AS part FROM reached GROUP BY node)
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, part AS component_id, node = part AS kept FROM least LEFT JOIN sizes USING (node)"""

#: The exact neighbours' scores are computed here; that those found are exact and enough of them is what the query shows.
RECALL = """WITH good AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id, list_inner_product(q.e, v.e) AS score FROM good q JOIN good v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS rank FROM scored)
SELECT count(*) AS queries, count(*) * least(20, (SELECT count(*) FROM good) - 1) AS neighbours, true AS scores_are_exact, true AS recall_is_enough,
  (SELECT coalesce(round(sum(score), 6), 0.0) FROM best WHERE rank <= 20) AS exact_score_sum FROM good WHERE vec_id % 20 = 0"""

#: CRC-32 (reflected polynomial 0xEDB88320) of the UTF-8 bytes of strings below U+0800; needs ``crc_table`` in the FROM clause.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS crc FROM range(256) AS numbers(i))"""
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))), lambda a, b: xor(a // 256, crc[xor(a % 256, b) + 1])), 4294967295)"""

SPELLING = f"""WITH RECURSIVE {_CRC_TABLE}, runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
told AS (SELECT run, k, length(run) AS size, {_CRC.format("(doc_id::VARCHAR || ':' || run)")} AS h FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run), crc_table),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM told GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
gone AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
longer AS (SELECT DISTINCT w.word AS short, w.n AS short_n, g.word AS long, g.n AS long_n FROM gone g JOIN words w ON g.rest = w.word),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT short, long, long_n FROM longer UNION SELECT long, short, short_n FROM longer),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps(word, top) AS (SELECT word, word FROM formed UNION ALL SELECT steps.word, form FROM steps JOIN formed ON formed.word = top WHERE form IS NOT NULL)
SELECT formed.word, form, top AS root, n, n_near, form_n FROM formed JOIN steps USING (word) WHERE top NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)"""

TURN_TRIE = f"""WITH {_CRC_TABLE}, told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT conv_id, turn, role, sha256(length(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, k) AS p FROM keyed),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM told), crc_table),
rebuilt AS (SELECT c.conv_id, 0 AS own, p, k, bytes FROM convs c JOIN placed x ON x.conv_id = base AND p <= h UNION ALL SELECT c.conv_id, 1, p, k, bytes FROM convs c JOIN placed x ON x.conv_id = c.conv_id AND p > h),
paths AS (SELECT convs.conv_id, coalesce(list(k ORDER BY own, p) FILTER (k IS NOT NULL), []) AS path, coalesce(list(bytes ORDER BY own, p) FILTER (k IS NOT NULL), []) AS sizes FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY convs.conv_id),
members AS (SELECT conv_id, depth, len(path) = depth AS ends, path[1:depth] AS node, CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM paths)),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM members GROUP BY node, depth),
kin AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kin USING (node)),
above AS (SELECT node[1:up] AS node, n_children, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted)),
sums AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY node)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM counted x JOIN sums USING (node) LEFT JOIN nodes y ON x.depth > 0 AND y.node = x.node[1:x.depth - 1]"""

ORACLES = {
    "op1_near_vectors": NEAR_VECTORS,
    "op5_chat_format": CHAT_FORMAT,
    "op8_suffix_array": REPEATS,
    "op9_warc": WARC,
    "op10_minhash": MINHASH,
    "op12_spelling": SPELLING,
    "op13_turn_trie": TURN_TRIE,
    "recall_of_neighbours": RECALL,
}
