"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations


#: Ranks, rates and offsets as in mixing.py, with the same order of floating-point steps.
OP10 = """
WITH d AS (
  SELECT doc_id, source, text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size
  FROM documents
), e AS (
  SELECT *, md5(concat_ws('|', '29', doc_id::VARCHAR, text)) AS noise, length(bin(size)) AS octave, substr(bin(size), 1, 4) AS lead4
  FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY octave, lead4, substr(noise, 1, 2), size, noise) AS k FROM e
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 2 AS most FROM s
), c AS (
  SELECT *,
    coalesce(sum(most) OVER o, 0)::BIGINT AS capped,
    (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS open_weight,
    (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS wanted
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (wanted - capped) / open_weight AS level FROM c
), f AS (
  SELECT (SELECT level FROM l WHERE level * weight <= most ORDER BY capped, level LIMIT 1) AS found
), t AS (
  SELECT source, source_size, coalesce(least(found * weight, most::DOUBLE), most::DOUBLE) AS target,
    md5('29|' || coalesce('s' || source, 'null')) AS m
  FROM l, f
), u AS (
  SELECT *, (((((
    (strpos('0123456789abcdef', m[1]) - 1) * 16 + strpos('0123456789abcdef', m[2]) - 1) * 16
    + strpos('0123456789abcdef', m[3]) - 1) * 16 + strpos('0123456789abcdef', m[4]) - 1) * 16
    + strpos('0123456789abcdef', m[5]) - 1) * 16 + strpos('0123456789abcdef', m[6]) - 1) / 16777216.0::DOUBLE AS off,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM t
)
SELECT r.doc_id, r.size::BIGINT AS size, u.source_size, u.target,
  (least(floor(r.k * rate + off) - floor((r.k - 1) * rate + off), 2)::BIGINT * r.size)::BIGINT AS taken
FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
"""


#: All pairs that share a shingle, then reachability: exact, and quick enough for small tables.
OP4 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * p.c >= 80 * (i.c + j.c - p.c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: What is left after the insert, the recount and the withdrawal, each counted once.
OP7 = """
SELECT source, lang, 'words-2' AS tokenizer, count(*) AS n_docs,
  sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]')))::BIGINT AS n_tokens
FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]') GROUP BY source, lang
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4, "op7_token_counts": OP7, "op10_systematic_mixing": OP10}
