"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op2_benchmark_decontamination"] = r"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, len(w[i:i + 12]) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p, grams.n AS n, item_id FROM grams JOIN wins ON grams.g = wins.g AND grams.n = wins.n),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

ORACLES["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id AS vec_id, c.r AS cr,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""

ORACLES["op3_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         14 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
            + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS total FROM n)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(total) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

ORACLES["op11_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(doc_id > least, false) THEN 16 ELSE 0 END AS f
  FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS v),
o AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.v, q.v, r.v, s.v, u.v] AS v
  FROM b p, b q, b r, b s, b u
  WHERE p.v + q.v + r.v + s.v + u.v = 31 AND len(list_distinct([p.v, q.v, r.v, s.v, u.v])) = 5),
k AS (SELECT filter_order, i AS step, v[i] AS own, coalesce(list_sum(v[1:i - 1]), 0)::INTEGER AS earlier FROM o, range(1, 6) g(i)),
r AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE f & own = 0 AND f & earlier = 0) AS kept,
         sum(n) FILTER (WHERE f & own > 0 AND f & earlier = 0) AS removed,
         sum(n) FILTER (WHERE f & own > 0 AND f & earlier > 0) AS redundant,
         sum(n) FILTER (WHERE f = own) AS unique_fails,
         sum(good) FILTER (WHERE f & own > 0 AND f & earlier = 0) AS good_lost,
         sum(toxic) FILTER (WHERE f & own > 0 AND f & earlier = 0) AS toxic_lost
  FROM c, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLES["op13_conversation_trie"] = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
bits AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS c FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])) ELSE c END AS x FROM bits WHERE i < 8 * length(s))),
h AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM bits WHERE i = 8 * length(s)),
f AS (SELECT a.conv_id, a.base, h, least(h, coalesce(b.n, 0)) AS n_head FROM ids a JOIN h USING (conv_id) LEFT JOIN ids b ON b.conv_id = a.base),
r AS (
  SELECT f.conv_id, pos, role, text FROM f JOIN t ON t.conv_id = f.base AND t.pos < f.h
  UNION ALL SELECT f.conv_id, pos - h + n_head, role, text FROM f JOIN t ON t.conv_id = f.conv_id AND t.pos >= f.h),
q AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS l FROM r GROUP BY conv_id),
w AS (SELECT f.conv_id, coalesce(l, []) AS l FROM f LEFT JOIN q USING (conv_id)),
p AS (SELECT conv_id, len(l) AS n, l[1:d] AS p, d FROM w, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)),
v AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(p[d].text), 0) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
own AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (p)),
below AS (
  SELECT p[1:a] AS p, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM own, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY 1)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
FROM own JOIN below ON below.p = own.p LEFT JOIN v above ON own.d > 0 AND above.p = own.p[1:own.d - 1]
"""
