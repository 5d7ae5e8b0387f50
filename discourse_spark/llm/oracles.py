"""The operators that SQL can express, in DuckDB's dialect, by brute force."""

from __future__ import annotations

EMBEDDING_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
  least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM vectors LEFT JOIN counted c ON c.a = vec_id LEFT JOIN lowest l ON l.a = vec_id
"""

MINMAX_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), items AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM sets LEFT JOIN lowest ON a = doc_id
"""

_ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _spans(kind: int, pattern: str, group: int) -> str:
    return f"""
  SELECT doc_id, source, lang, {kind} AS kind, unnest(regexp_extract_all(t, '{pattern}', {group})) AS value,
    unnest(list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x))) AS size,
    unnest(list_transform(string_split_regex(t, '{pattern}')[: len(regexp_extract_all(t, '{pattern}', 0))], lambda x: length(x))) AS gap,
    unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) AS i
  FROM texts WHERE regexp_matches(t, '{pattern}')"""


SECRET_SQL = f"""
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(_spans(k, p, g) for k, p, g in (
    (0, _ASSIGN, 2), (1, "AKIA[A-Z0-9]{16,}", 0), (2, "[0-9a-f]{24,}", 0), (3, "[A-Za-z0-9+/_-]{20,}", 0)))}),
placed AS (
  SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM matches
), found AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS repository, kind, value, stop - size AS start, stop
  FROM placed WHERE (kind <> 0 OR length(value) >= 6) AND (kind <> 3 OR (
    regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')))
), owners AS (SELECT value, count(DISTINCT owner) < 3 AS is_live FROM found GROUP BY value),
rated AS MATERIALIZED (SELECT f.*, is_live FROM found f JOIN owners USING (value)),
kept AS (
  SELECT * FROM rated r WHERE kind <> 3 OR (is_live AND NOT EXISTS (
    SELECT 1 FROM rated b WHERE b.doc_id = r.doc_id AND b.kind <> 3 AND b.start < r.stop AND r.start < b.stop))
), named AS (
  SELECT *, ['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || start || ':' || stop AS name FROM kept
), lists AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (is_live) AS n_live,
    string_agg(name, ',' ORDER BY start, kind) AS spans,
    string_agg(name, ',' ORDER BY start, kind) FILTER (kind <> 3) AS base
  FROM named GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM texts LEFT JOIN lists USING (doc_id)
"""

PHRASE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
phrases AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
    FROM words, range(1, 5) AS sizes(m) WHERE len(w) >= m
  ) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, (CAST(c.f AS HUGEINT) * 2000000) // (h.f + t.f) AS score
  FROM candidates c JOIN range(1, 4) AS places(k) ON k < c.m
  JOIN phrases h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[: k], ' ')
  JOIN phrases t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1 :], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), within AS (
  SELECT c.lang, array_to_string(c.w[i : i + size - 1], ' ') AS phrase, max(c.f) AS longer
  FROM candidates c JOIN range(2, 4) AS sizes(size) ON size < c.m JOIN range(1, 4) AS starts(i) ON i <= c.m - size + 1
  GROUP BY ALL
), kept AS (
  SELECT x.* FROM lowest x LEFT JOIN within y USING (lang, phrase) WHERE y.longer IS NULL OR 100 * y.longer < 80 * x.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
