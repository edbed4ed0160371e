"""DuckDB SQL for the operators that SQL can express on whole tables."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {docs}
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (
    SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id
), l0 AS (SELECT doc_id, source, text, unnest(lines) AS line FROM d
), l AS (
  SELECT doc_id, source, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM l0
), hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source
), f AS (
  SELECT l.source, l.line FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.line, h.host_docs
  HAVING count(DISTINCT l.text) > 20 AND count(DISTINCT l.text) > 0.05 * h.host_docs
), m AS (SELECT l.doc_id, sum(l.n) AS n FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY l.doc_id
), b AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id)
), v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT *, (NOT base_failed AND 100 * (n_words - n_removed_words) >= 50 * n_words) AS kept FROM v
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS ws FROM {{docs}}
), b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, {_ALNUM}) AS ws FROM {{benchmark}}
), bw AS (
  SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)
), hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, win)
), words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def quality_rules(docs: str = "documents") -> str:
    return QUALITY_RULES.replace("{docs}", docs)


def decontamination(docs: str = "documents", benchmark: str = "benchmark") -> str:
    return DECONTAMINATION.replace("{docs}", docs).replace("{benchmark}", benchmark)


JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + {k} - 1], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {k} + 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= {percent} * (na.n + nb.n - n_both)
), r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d
)
SELECT d AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""


def jaccard(docs: str = "documents", k: int = 3, percent: int = 90) -> str:
    return JACCARD.replace("{docs}", docs).replace("{k}", str(k)).replace("{percent}", str(percent))
