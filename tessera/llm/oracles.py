"""DuckDB SQL of the queries that SQL can express, by plainer paths: all pairs by shared shingles or by cosine, and string aggregation."""

from __future__ import annotations

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS m FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.m = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(m) AS component_id, vec_id = min(m) AS kept FROM r GROUP BY vec_id
"""

CHAT_FORMAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(k)),
e AS (SELECT *, length(text) + coalesce(list_sum(list_transform(regexp_extract_all(text, '(\\*)(</?s>|\[/?(?:INST|ROLE)\]|\z)', 1), lambda x: length(x))), 0) + len(regexp_extract_all(text, '</?s>|\[/?(?:INST|ROLE)\]')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n + length(role) + length('<s>[ROLE][/ROLE][INST][/INST]</s>') + 1) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

QUALITY_RULES = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) > 2),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
v AS (SELECT r, count(DISTINCT i + k) AS n FROM m, range(3) x(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT x) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM w LEFT JOIN v USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 3 * n_words OR word_chars > 10 * n_words AS f5 FROM c),
h AS (SELECT source, k AS rule, count(*) AS n, count(*) FILTER ([f1, f2, f3, f4, f5][k]) AS k FROM f, range(1, 6) x(k) WHERE source IS NOT NULL GROUP BY source, x.k),
p AS (SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 - mean * (1 - mean) * count(*) / sum(n) AS apart FROM h GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN apart * 1000000 > mean * (1 - mean) THEN greatest(mean * (1 - mean) / apart - 1, 2) ELSE 1000000 END AS strength FROM p),
b AS (SELECT source, (k + mean * strength) / (n + strength) AS rate, rate - 3 * sqrt(rate * (1 - rate) / (n + strength + 1)) AS low FROM h JOIN s USING (rule)),
u AS (SELECT source, CASE WHEN max(low) >= 0.8 THEN 'reject' WHEN max(low) >= 0.5 THEN 'strict' ELSE 'keep' END AS verdict FROM b GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND CASE coalesce(verdict, 'keep') WHEN 'reject' THEN false WHEN 'strict' THEN NOT (f3 OR f4 OR f5) ELSE true END AS kept, coalesce(verdict, 'keep') AS verdict
FROM f LEFT JOIN u USING (source)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""


def vector_codes(rounds: int = 4) -> str:
    """Rounds one after the other; squared distances from products of integers in double precision, exact under 2^53."""
    steps = [
        """WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, p, list_slice(e, CAST(p * len(e) / 4 AS INTEGER) + 1, CAST((p + 1) * len(e) / 4 AS INTEGER)) AS x FROM k, range(4) q(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS n, x AS c FROM v WHERE r <= 256)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{d: list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), n: n}}) AS best FROM v JOIN c{i} USING (p) GROUP BY r, p)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT p, n, list(m ORDER BY j) AS c FROM (SELECT p, best.n AS n, j, floor(sum(x[j]) / count(*)) AS m FROM a{i}, range(1, 1025) q(j) WHERE j <= len(x) GROUP BY p, best.n, j) GROUP BY p, n)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (p, n))")
    last = f"""o AS (SELECT r, string_agg(printf('%02x', best.n), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, n)) FROM c{rounds}) AS codebooks_sha256 FROM o JOIN k USING (r)"""
    return ",\n".join([*steps, last])
