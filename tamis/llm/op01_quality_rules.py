"""Query: line-first quality rules over all documents."""

from __future__ import annotations

from tamis.llm.quality_rules import CLOSING, NOISE, PHRASES, SEPARATORS, SYMBOLS, judge_documents
from tamis.llm.registry import query, read


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(column: str, parts) -> str:
    """Occurrences of the parts, none of which overlaps itself."""
    return "(" + " + ".join(f"(len({column}) - len(replace({column}, {_quoted(p)}, ''))) // {len(p)}" for p in parts) + ")"


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY r),
raw AS (SELECT r, unnest(string_split(t, chr(10))) AS raw FROM d),
ln AS (SELECT r, raw, trim(raw, {SPACE}) AS l FROM raw WHERE trim(raw, {SPACE}) <> ''),
f AS (SELECT r, raw, l, strlen(l) AS b, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  {_count('l', [' '])} + 1 AS nw, {_count('l', SEPARATORS)} AS seps, {_count('l', NOISE)} AS noise, {_count('l', ['!!'])} AS ex FROM ln),
g AS (SELECT r, raw, b, CASE WHEN {' OR '.join(f"contains(low, {_quoted(p)})" for p in PHRASES)} THEN 'b'
  WHEN seps >= 2 AND seps * 4 >= nw THEN 'n'
  WHEN (ex > 0 AND 2 * ex >= nw) OR (noise >= 2 AND noise >= 0.25 * nw)
    OR (nw >= 5 AND ((regexp_matches(l, '[A-Z]') AND NOT regexp_matches(l, '[a-z]')) OR right(l, 1) NOT IN ({', '.join(map(_quoted, CLOSING))}))) THEN 'p' END AS fault FROM f),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT raw) AS n_dup_lines, count(*) FILTER (fault = 'b') AS n_boilerplate,
  count(*) FILTER (fault = 'n') AS n_navigation, count(*) FILTER (fault = 'p') AS n_punctuation,
  CAST(sum(b) AS BIGINT) AS line_bytes, CAST(coalesce(sum(b) FILTER (fault IS NOT NULL), 0) AS BIGINT) AS lost_bytes FROM g GROUP BY r),
a AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST({_count('t', SYMBOLS)} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_navigation, 0) AS n_navigation,
  coalesce(n_punctuation, 0) AS n_punctuation, coalesce(line_bytes, 0) AS line_bytes, coalesce(lost_bytes, 0) AS lost_bytes
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_bytes <= 0.6 * line_bytes AS kept FROM a
"""


@query("op1_quality_rules", SQL)
def op1_quality_rules(spark, sf_dir):
    return judge_documents(read(spark, sf_dir, "documents"))
