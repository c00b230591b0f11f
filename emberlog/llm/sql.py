"""DuckDB SQL for the training-data queries that SQL can express.

The others train models, hash with functions that DuckDB lacks, or draw pseudorandom numbers; tests hold
them against brute force, exact round trips or held-out accuracy.
"""

_WORD = r"[^\x20\x09-\x0D]"

ORACLES: dict[str, str] = {
    "op3_line_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT *, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice FROM q),
s AS (SELECT doc_id, twice OR coalesce(lag(twice) OVER x, false) OR coalesce(lag(twice, 2) OVER x, false) AS inside FROM r WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM s GROUP BY 1),
l AS (SELECT doc_id, source, unnest(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(lower(x), '\p{{Nd}}+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '')) AS line FROM d),
f AS (SELECT source, line FROM l GROUP BY ALL HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_lost_words <= 0.5 * n_words AS kept, n_lost_words FROM e""",
}

#: SQL for some columns of queries that SQL can't express as a whole.
PARTS: dict[str, str] = {
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u""",
    "op10_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM d GROUP BY 1),
r AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS light
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(least(2 * source_size, (SELECT max(rest / light) FROM r) * w) AS DOUBLE) AS target FROM r)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
