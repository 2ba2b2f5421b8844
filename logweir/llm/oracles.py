"""DuckDB SQL of the queries of this package, where SQL can express them."""

from __future__ import annotations

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), ring AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
), sources AS (
  SELECT source, sum(size) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]
           ::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight > source_size * 2.0 THEN CAST(source_size * 2.0 AS DOUBLE)
              ELSE weight * (SELECT arg_min(level, source_size * 2.0 / weight) FROM levels
                             WHERE level * weight <= source_size * 2.0) END AS target
  FROM levels
), asked AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS demand,
         CASE WHEN source_size > 0
              THEN CAST(floor(target + 0.5) AS BIGINT) // CAST(source_size AS BIGINT)
              ELSE 0 END AS rounds
  FROM targets
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(rounds * size + greatest(0, least(demand - rounds * source_size - before, size))
            AS BIGINT) AS taken
FROM ring JOIN asked ON ring.source IS NOT DISTINCT FROM asked.source
"""

URL_VERDICTS = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query
  FROM pages
), addressed AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query
            END AS address
  FROM parsed
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT host, path, address, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM addressed WHERE address IS NOT NULL
), targets AS (
  SELECT host, path, address, trim(CASE
      WHEN regexp_matches(tag, '(?is)^<link.*[\s"'']rel\s*=\s*["'']?[^"''>]*\bcanonical\b')
        THEN regexp_extract(tag, '(?is)[\s"'']href\s*=\s*["'']?([^"''>\s]+)', 1)
      WHEN regexp_matches(tag, '(?is)^<meta.*http-equiv\s*=\s*["'']?\s*refresh')
        THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''>]*)', 1)
      ELSE '' END) AS target
  FROM tags
), full_targets AS (
  SELECT address, CASE
      WHEN regexp_matches(target, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
      WHEN target LIKE '//%' THEN 'x:' || target
      WHEN target LIKE '/%' THEN 'x://' || host || target
      ELSE 'x://' || host || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/'
           ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || target END AS url
  FROM targets WHERE target <> ''
), links AS (
  SELECT DISTINCT address AS a,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || CASE WHEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/'
            ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END
         || regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS b
  FROM full_targets WHERE regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) <> ''
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM edges
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), nodes AS (
  SELECT DISTINCT a AS address, regexp_extract(a, '(?s)^([^/?#]*)', 1) AS host,
         regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM edges
), judged AS (
  SELECT address, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM nodes n JOIN rules r ON (n.host = r.host OR suffix(n.host, '.' || r.host))
       AND starts_with(n.path, r.path) GROUP BY address
), shared AS (
  SELECT a AS address, min(verdict) AS verdict FROM (SELECT a, b FROM reach UNION SELECT a, a FROM edges)
  JOIN judged ON b = judged.address GROUP BY a
), own AS (
  SELECT p.page_id, p.host, p.path, p.address,
         arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM addressed p LEFT JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host))
       AND starts_with(p.path, r.path) GROUP BY ALL
)
SELECT page_id, own.host, own.path, own.rule,
       coalesce(own.verdict, shared.verdict, 'allow') AS verdict
FROM own LEFT JOIN shared ON own.address = shared.address
"""

QUALITY_RULES = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
), listed AS (
  SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM split
), windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER t AS w1, lead(w, 2) OVER t AS w2, lead(w, 3) OVER t AS w3,
         lead(w, 4) OVER t AS w4
  FROM listed WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, w4 IS NOT NULL
         AND count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) > 1 AS twice
  FROM windows
), covered AS (
  SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i
                                     ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again
  FROM counted
), repeats AS (
  SELECT doc_id, count(*) FILTER (again) AS n_repeat_words FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts
), kept_lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(w) FOR w IN words]), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM split LEFT JOIN repeats USING (doc_id) LEFT JOIN kept_lines USING (doc_id)
), bits AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
         + 4 * (100 * n_symbols > 10 * word_chars)::INT
         + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
         + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT AS BIGINT) AS failures
  FROM measured
)
SELECT *, failures & 3 <> 0 AS base_failed, failures & 31 = 0 AS kept FROM bits
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op4_source_mix": SOURCE_MIX,
        "op7_url_verdicts": URL_VERDICTS,
        "op9_quality_rules": QUALITY_RULES,
    }
