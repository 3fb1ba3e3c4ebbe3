"""Query: the 50 best documents of every benchmark item."""

from __future__ import annotations

from tamis.llm.lexical_search import search
from tamis.llm.registry import query, read

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LOWER} AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
lengths AS (SELECT r, count(*) AS n FROM w GROUP BY r),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS words FROM lengths),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(t, '{TERM}')) AS terms
  FROM (SELECT DISTINCT item_id, {LOWER} AS t, text FROM benchmark)),
it AS (SELECT i, item_id, unnest(terms) AS term FROM i),
tf AS (SELECT r, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM it) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
impacts AS (SELECT tf.r, tf.term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)) AS impact
  FROM tf JOIN lengths USING (r), totals),
scores AS (SELECT it.i, it.item_id, p.r, CAST(sum(wt.w * p.impact) AS BIGINT) AS score
  FROM it JOIN wt USING (term) JOIN impacts p ON p.term = it.term GROUP BY it.i, it.item_id, p.r),
ranked AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op12_lexical_search", SQL)
def op12_lexical_search(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
