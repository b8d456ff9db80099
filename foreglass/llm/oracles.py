"""DuckDB SQL for the dealt operators that SQL can state on whole tables."""

from __future__ import annotations

OP4 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS number, 3 * words AS room FROM s),
a AS (SELECT *, (sum(words) OVER ())::BIGINT AS all_words, (sum(weight) OVER ())::BIGINT AS all_weight,
        coalesce(sum(room) OVER e, 0)::BIGINT AS room_before, coalesce(sum(weight) OVER e, 0)::BIGINT AS weight_before
      FROM w WINDOW e AS (ORDER BY room::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(((all_words - room_before) * weight)::DOUBLE > (room * (all_weight - weight_before))::DOUBLE)
               OVER (ORDER BY room::DOUBLE / weight, number ROWS UNBOUNDED PRECEDING) AS full_up FROM a),
g AS (SELECT *, (sum(CASE WHEN full_up THEN room ELSE 0 END) OVER ())::BIGINT AS fw,
             (sum(CASE WHEN full_up THEN weight ELSE 0 END) OVER ())::BIGINT AS fv FROM f),
t AS (SELECT source, words, CASE WHEN full_up THEN room::DOUBLE
                                 ELSE ((all_words - fw) * weight)::DOUBLE / (all_weight - fv)::DOUBLE END AS target FROM g),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget,
             CASE WHEN words > 0 THEN (floor(target + 0.5)::BIGINT // words) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, p.size, b.words AS source_size, b.target,
       (epochs * p.size + greatest(0, least(budget - epochs * b.words - before, p.size)))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""

OP1 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
       FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, sizes WHERE len(w) >= l)),
m AS (SELECT r, i, dw.l, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items,
             string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, item_id, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP6 = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, links.y FROM r JOIN links ON r.y = links.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g
"""

OP10 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS n
           FROM documents),
r AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
             row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST) = 1 AS kept,
             count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(n) AS text_sha256 FROM r
"""

OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, links.y FROM r JOIN links ON r.y = links.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

OP12 = """
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE length(o) < 5 AND NOT contains(o, f)),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e,
         coalesce((SELECT bool_or(quality = 1) FROM labels l WHERE l.doc_id = d.doc_id), false) AS good,
         coalesce((SELECT bool_or(toxic = 1) FROM labels l WHERE l.doc_id = d.doc_id), false) AS toxic
  FROM d),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
             || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n,
             count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
s AS (SELECT part, o, step, substr(o, step, 1) AS letter, fails, n, good, toxic,
             regexp_matches(fails, '[' || substr(o, step, 1) || ']') AS failing,
             step > 1 AND regexp_matches(fails, '[' || substr(o || 'x', 1, greatest(step - 1, 1)) || ']') AS gone
      FROM g, (SELECT o FROM orders WHERE length(o) = 5), (SELECT unnest(range(1, 6))::INT AS step)),
x AS (SELECT part, o, step, letter, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
             sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
             sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, o AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM x
"""

SQL = {
    "op1_decontaminate": OP1,
    "op4_mix": OP4,
    "op6_near_dedup": OP6,
    "op9_warc": OP9,
    "op10_exact_dedup": OP10,
    "op11_embedding_dedup": OP11,
    "op12_filter_audit": OP12,
}
