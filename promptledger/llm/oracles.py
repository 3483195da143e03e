"""SQL equivalents of the pipeline queries, where SQL can express them."""

from __future__ import annotations

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict),
                          length(rule_host || rule_path)) AS best
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT parts.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spelled AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g
  FROM spelled),
f AS (
  SELECT lang, m, array_to_string(g[1:m], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM places, (VALUES (1), (2), (3)) lengths(m)
  WHERE g[m] IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
found AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 10),
longer AS (
  SELECT lang, array_to_string(ws[side : side + 1], ' ') AS phrase, max(a) AS longest
  FROM found, (VALUES (1), (2)) sides(side) WHERE m = 3 GROUP BY ALL),
covered AS (
  SELECT lang, phrase FROM found JOIN longer USING (lang, phrase) WHERE m = 2 AND 100 * longest >= 50 * a),
cuts AS (
  SELECT found.*, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS tail
  FROM found, (VALUES (1), (2)) ks(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, k, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang || ' ' || x.phrase = c.lang || ' ' || c.head
    JOIN f y ON y.lang || ' ' || y.phrase = c.lang || ' ' || c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

CODES = r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x
  FROM kept, (SELECT unnest(range(16)) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS (SELECT p, e, x AS c FROM parts JOIN first USING (vec_id)),
near1 AS (
  SELECT vec_id, parts.p, x, arg_min(e, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e)) AS e
  FROM parts JOIN book0 ON parts.p = book0.p GROUP BY ALL),
sums1 AS (
  SELECT p, e, d, sum(y)::BIGINT AS s, count(*) AS k FROM (
    SELECT p, e, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS y FROM near1) GROUP BY ALL),
mean1 AS (
  SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY d) AS c FROM sums1 GROUP BY p, e),
book1 AS (SELECT p, e, coalesce(mean1.c, book0.c) AS c FROM book0 LEFT JOIN mean1 USING (p, e)),
near2 AS (
  SELECT vec_id, parts.p, x, arg_min(e, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e)) AS e
  FROM parts JOIN book1 ON parts.p = book1.p GROUP BY ALL),
sums2 AS (
  SELECT p, e, d, sum(y)::BIGINT AS s, count(*) AS k FROM (
    SELECT p, e, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS y FROM near2) GROUP BY ALL),
mean2 AS (
  SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY d) AS c FROM sums2 GROUP BY p, e),
book2 AS (SELECT p, e, coalesce(mean2.c, book1.c) AS c FROM book1 LEFT JOIN mean2 USING (p, e)),
last AS (
  SELECT vec_id, parts.p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e)::BIGINT AS best
  FROM parts JOIN book2 ON parts.p = book2.p GROUP BY ALL),
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(best % 64)), 2, '0'), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
  FROM last GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""

SHINGLE_COMPONENTS = r"""
WITH RECURSIVE spelled AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
    WHEN len(ws) > 0 THEN [len(ws) || ':' || array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM spelled),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(v, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT v AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = v GROUP BY v
"""

VECTOR_COMPONENTS = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(v, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT v AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r) AS component_id, v = min(r) AS kept
FROM reach LEFT JOIN counts ON counts.a = v GROUP BY v
"""

ORACLES: dict[str, str] = {
    "op3_bloom_url_filter": URL_FILTER,
    "op7_signature_tree_join": SHINGLE_COMPONENTS,
    "op9_graph_near_duplicates": VECTOR_COMPONENTS,
    "op12_stripe_collocations": COLLOCATIONS,
    "op13_anchor_codes": CODES,
}
