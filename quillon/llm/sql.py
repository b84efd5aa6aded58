"""DuckDB SQL of the queries that SQL can state."""

_RANKS = """
WITH lead AS (SELECT export_id, lead_id, max(score) AS s, max(raw_id) AS raw_id FROM lead_row GROUP BY ALL),
v AS (
  SELECT export_id, lead_id, coalesce(CASE WHEN NOT isnan(s) THEN s END, '-infinity'::DOUBLE) AS s0,
    coalesce(ratings_count::DOUBLE, '-infinity'::DOUBLE) AS s1,
    coalesce(CASE WHEN NOT isnan(average_rating) THEN average_rating END, '-infinity'::DOUBLE) AS s2
  FROM lead LEFT JOIN raw_book USING (raw_id)),
r AS (
  SELECT export_id, lead_id,
    rank() OVER a + (count(*) OVER (PARTITION BY export_id, s0) - 1) / 2.0 AS r0,
    rank() OVER b + (count(*) OVER (PARTITION BY export_id, s1) - 1) / 2.0 AS r1,
    rank() OVER c + (count(*) OVER (PARTITION BY export_id, s2) - 1) / 2.0 AS r2
  FROM v WINDOW a AS (PARTITION BY export_id ORDER BY s0), b AS (PARTITION BY export_id ORDER BY s1), c AS (PARTITION BY export_id ORDER BY s2)),
z AS (
  SELECT export_id, lead_id,
    coalesce((r0 - avg(r0) OVER e) / nullif(stddev_pop(r0) OVER e, 0), 0) AS z0,
    coalesce((r1 - avg(r1) OVER e) / nullif(stddev_pop(r1) OVER e, 0), 0) AS z1,
    coalesce((r2 - avg(r2) OVER e) / nullif(stddev_pop(r2) OVER e, 0), 0) AS z2
  FROM r WINDOW e AS (PARTITION BY export_id)),
p AS (SELECT export_id, lead_id, round((z0 + z1 + z2) / sqrt(3), 9) AS projection, z0, z1, z2 FROM z)
"""

#: The plain component by power iteration on DuckDB's own correlations.
_COMPONENT = _RANKS.replace("WITH lead", "WITH RECURSIVE lead") + """
, m AS (SELECT corr(z0, z1) AS c01, corr(z0, z2) AS c02, corr(z1, z2) AS c12 FROM z),
power AS (
  SELECT 0 AS i, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c
  UNION ALL
  SELECT i + 1, x / n, y / n, w / n FROM (
    SELECT i, x, y, w, sqrt(x * x + y * y + w * w) AS n FROM (
      SELECT i, a + c01 * b + c02 * c AS x, c01 * a + b + c12 * c AS y, c02 * a + c12 * b + c AS w FROM power, m WHERE i < 2000))),
vec AS (SELECT a, b, c, (a * a + b * b + c * c + 2 * (c01 * a * b + c02 * a * c + c12 * b * c)) / 3 AS explained,
  (3 + 2 * (c01 + c02 + c12)) / 9 AS even FROM power, m WHERE i = 2000)
"""

SQL = {
    "p1_found": _RANKS + "SELECT export_id, lead_id FROM p QUALIFY row_number() OVER (PARTITION BY export_id ORDER BY projection DESC, lead_id) <= 5",
    "p1_ranking": _COMPONENT + "SELECT export_id, lead_id, projection, round(a * z0 + b * z1 + c * z2, 6) AS component FROM p, vec",
    "p1_loadings": _COMPONENT
    + """
SELECT score, round(loading, 6) AS loading, round(explained, 6) AS explained, round(1 / sqrt(3), 6) AS balanced_loading, round(even, 6) AS balanced_explained
FROM (SELECT 'score' AS score, a AS loading, explained, even FROM vec UNION ALL SELECT 'b_ratings', b, explained, even FROM vec UNION ALL SELECT 'b_average', c, explained, even FROM vec)""",
    "p2_found": """
WITH n AS (
  SELECT b.*, m.trust, count(*) OVER (PARTITION BY dedupe_key) AS rows_of_key,
    lower(trim(regexp_replace(publisher, '[\\s\\x{00A0}]+', ' ', 'g'))) AS pub
  FROM normalized_book b LEFT JOIN source_meta m ON m.id = b.source_id WHERE dedupe_key IS NOT NULL),
c AS (
  SELECT dedupe_key, norm_id, trust, seen_at, 'publisher' AS field_name FROM n WHERE rows_of_key > 1 AND pub <> '' AND regexp_matches(pub, '[\\p{L}\\p{N}]')
    AND NOT ends_with(pub, '…') AND NOT ends_with(pub, '..')
    AND pub NOT IN ('n/a', 'na', 'n.a.', 's.n.', 'self', 'various', 'unknown', 'unknown publisher', 'no publisher', 'none given', 'none', '(none)', 'not stated', 'tbc', 'tbd', 'xxx', '0', '[publisher not identified]')
  UNION ALL
  SELECT dedupe_key, norm_id, trust, seen_at, 'page_count' FROM n WHERE rows_of_key > 1 AND page_count BETWEEN 4 AND 9000
  UNION ALL
  SELECT dedupe_key, norm_id, trust, seen_at, 'published_on' FROM n WHERE rows_of_key > 1 AND year(published_on) BETWEEN 1951 AND 2027 AND published_on <> DATE '1970-01-01')
SELECT dedupe_key, field_name, norm_id FROM c
QUALIFY row_number() OVER (PARTITION BY dedupe_key, field_name ORDER BY trust DESC NULLS LAST, seen_at DESC NULLS LAST, norm_id) = 1
""",
}
