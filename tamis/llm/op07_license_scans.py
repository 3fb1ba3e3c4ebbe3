"""Query: licences named or carried by all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.llm.licenses import TEMPLATES, THRESHOLD, normalised, scan
from tamis.llm.registry import query, read

_ROWS = ", ".join(f"({i}, '{t.license}', '{normalised(t.text)}')" for i, t in enumerate(TEMPLATES))
SQL = rf"""
WITH t0(i, license, s) AS (VALUES {_ROWS}),
t1 AS (SELECT i, license, unnest(range(1, len(string_split(s, ' ')))) AS p, string_split(s, ' ') AS w FROM t0),
tg AS (SELECT DISTINCT i, license, w[p] || ' ' || w[p + 1] AS g FROM t1),
tn AS (SELECT i, license, count(*) AS nb FROM tg GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
u0 AS (SELECT r, unnest(list_concat(list_concat(string_split(t, chr(10)), string_split_regex(t, '\n *\n')), [t])) AS u FROM d),
u AS (SELECT DISTINCT r, trim(regexp_replace(u, '[ \n]+', ' ', 'g')) AS u FROM u0),
g0 AS (SELECT r, u, string_split(u, ' ') AS w, unnest(range(1, len(string_split(u, ' ')))) AS p FROM u),
g AS (SELECT DISTINCT r, u, w[p] || ' ' || w[p + 1] AS g FROM g0),
n AS (SELECT r, u, count(*) AS na FROM g GROUP BY ALL),
x AS (SELECT r, u, i, license, count(*) AS c FROM g JOIN tg USING (g) GROUP BY ALL),
m AS (SELECT r, x.license, max(2.0 * c / (na + nb)) AS dice FROM x JOIN n USING (r, u) JOIN tn USING (i) WHERE CAST(2.0 * c / (na + nb) AS DOUBLE) >= {THRESHOLD} GROUP BY ALL),
a AS (SELECT r, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, CAST(max(dice) AS DOUBLE) AS best_dice FROM m GROUP BY r)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, best_dice FROM d LEFT JOIN a USING (r)
"""


@query("op7_license_scans", SQL)
def op7_license_scans(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda m: m["license"]), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda m: m["dice"])).alias("best_dice"),
    )
