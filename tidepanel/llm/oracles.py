"""DuckDB SQL for the queries of this subpackage that SQL can express; words and windows as plain strings and lists."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(ws) - 18)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(20) AS g(j)),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
pos AS (SELECT d.doc_id, u.p, ws[u.p] AS x FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.p) AS t FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p
         WHERE gone.p IS NULL GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM d, unnest(range(1, len(ws) - 2)) AS u(i)
      UNION ALL SELECT doc_id, '#' || array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
       FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM d, ms, unnest(range(1, len(ws) - m + 2)) AS u(i)),
hits AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, k)),
cover AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits) h, unnest(range(m)) AS g(j)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM cover GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(m.vec_id, coalesce(c.m, m.vec_id)) AS component_id,
       m.vec_id = least(m.vec_id, coalesce(c.m, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) k ON k.a = m.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = m.vec_id
"""

OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS c,
      regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM d),
m AS (SELECT part, [a, b, c, d, e] AS fails, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM f),
k AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [p.x, q.x, r.x, s.x, u.x] AS ord FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
st AS (SELECT ord, array_to_string(list_transform(ord, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, l.x AS step, ord[l.x] AS own, ord[1:l.x - 1] AS before FROM o, l),
g AS (SELECT part, filter_order, step, own,
      sum(CASE WHEN NOT fails[own] AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails[own] AND NOT earlier THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN fails[own] AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails[own] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN fails[own] AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails[own] AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
      FROM (SELECT *, len(list_filter(before, lambda x: fails[x])) > 0 AS earlier FROM k, st) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""

OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
c AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((strpos('0123456789abcdef', substr(h || '0', i * 5 // 4 + 1, 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(h || '0', i * 5 // 4 + 2, 1)) - 1) // CAST(2 ** (3 - i * 5 % 4) AS INTEGER)) % 32, 1)) AS b FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(b, '') AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM c
"""

ORACLES = {"op4_embedding_hnsw": OP4, "op2_substring_dedup": OP2, "op5_ngram_jaccard_join": OP5, "op6_decontamination": OP6, "op11_filter_audit": OP11, "op13_warc": OP13}
