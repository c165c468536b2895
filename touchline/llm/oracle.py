"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

#: ASCII letters to lower case, words between ASCII white space.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _components(links: str, nodes: str) -> str:
    """reach(id, root): every node with the smallest node that links (a, b) lead to."""
    return f"""walk(id, root) AS (
      SELECT id, id FROM {nodes}
      UNION
      SELECT l.b, w.root FROM walk w JOIN {links} l ON w.id = l.a WHERE w.root < l.b),
    reach AS (SELECT id, min(root) AS root FROM walk GROUP BY id)"""


OP1 = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_components('links', '(SELECT doc_id AS id FROM documents)')}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN reach ON doc_id = id
"""

OP4 = rf"""
WITH docs AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_ALNUM}, []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, v.item FROM places p JOIN windows v ON p.size = v.size AND p.g = v.g),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda c: coalesce(isfinite(c), FALSE)), FALSE) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
{_components('links', '(SELECT vec_id AS id FROM embeddings)')}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN reach ON vec_id = id
"""

#: CRC-32 of decimal ids, digit by digit, over the table of the 256 bytes.
_CRC = """bytes(b, c) AS (SELECT range, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, range) FROM range(256)),
  crcs(conv_id, left_over, c) AS (
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM conversations
    UNION ALL
    SELECT conv_id, left_over[2:], xor(crcs.c // 256, bytes.c) FROM crcs JOIN bytes ON bytes.b = xor(crcs.c % 256, CAST(ascii(left_over[1]) AS BIGINT)) WHERE left_over <> ''),
  counts AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crcs WHERE left_over = '')"""
OP11 = f"""
WITH RECURSIVE {_CRC},
plain AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t.role, t.text) AS own
  FROM (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
rebuilt AS (
  SELECT p.conv_id, coalesce(b.own[:h], []) || p.own[h + 1:] AS path FROM plain p JOIN counts USING (conv_id) LEFT JOIN plain b ON b.conv_id = p.conv_id - p.conv_id % 100),
prefixes AS (SELECT conv_id, d, path[:d] AS path, d = len(path) AS ends FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, path),
placed AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.path[:n.d] = n.path) AS kids FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[:n.d - 1]),
below AS (
  SELECT path[:a] AS path, a AS d, count(*) FILTER (kids = 0) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * length(path[d].text) ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM placed) GROUP BY ALL)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM placed JOIN below USING (d, path)
"""

OP12 = """
WITH codes AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda c: coalesce(isfinite(c), FALSE)), FALSE)),
scores AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM codes a JOIN codes b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3
"""

ORACLE_SQL: dict[str, str] = {"op1_minhash": OP1, "op4_decontaminate": OP4, "op8_embeddings": OP8, "op11_trie": OP11, "op12_negatives": OP12}
