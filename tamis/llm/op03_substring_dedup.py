"""Query: all documents without the passages that repeat."""

from __future__ import annotations

from tamis.llm.registry import query, read
from tamis.llm.substrings import remove_repeats

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, list_slice(ws, i, i + 34) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(g, ' '))) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM dup),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT w.r, count(gone.p) AS n_removed, coalesce(string_agg(w.w, ' ' ORDER BY w.p) FILTER (gone.p IS NULL), '') AS kept
  FROM w LEFT JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


@query("op3_substring_dedup", SQL)
def op3_substring_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")
