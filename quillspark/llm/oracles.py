"""SQL of those queries that SQL can express."""

OP5 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (x) WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::bigint AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN response <> page_id THEN response END AS refers_to
FROM r
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(node, source) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, source FROM reach JOIN links ON a = node),
c AS (SELECT node, min(source) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS place, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> ''))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::double AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 2 * z AS most, 1.5::double * sum(z) OVER () AS total FROM s),
stopped AS (SELECT *, (total - coalesce(sum(most) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level
    FROM w WINDOW up AS (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT level FROM stopped WHERE w * level <= most ORDER BY most / w, r LIMIT 1),
t AS (SELECT source, r, z::bigint AS source_size, CASE WHEN total = 0 THEN 0 ELSE least(w * level, most) END AS target, total FROM w LEFT JOIN found ON true),
q AS (SELECT d.*, r, source_size, target, total, sum(size) OVER (PARTITION BY r ORDER BY place, size ROWS UNBOUNDED PRECEDING) AS served FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, (p * source_size + served) / target AS finish FROM q, range(2) AS x(p) WHERE size > 0),
mix AS (SELECT *, sum(size) OVER (ORDER BY finish, r ROWS UNBOUNDED PRECEDING) <= total AS fits FROM passes),
n AS (SELECT r, served, sum(size) FILTER (WHERE fits)::bigint AS taken FROM mix GROUP BY r, served)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::bigint AS taken FROM q LEFT JOIN n USING (r, served)
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::double)::bigint for c in embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::bigint AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::int AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""

ORACLES = {"op5_substring": OP5, "op6_warc": OP6, "op9_embeddings": OP9, "op11_mixing": OP11, "op13_negatives": OP13}
