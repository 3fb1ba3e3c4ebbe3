"""Query: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.llm.registry import query, read
from tamis.llm.secrets import RULES, scan

BASE = ("assign", "access", "hex")


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"], s["end"])), ",")


def _sql() -> str:
    parts = []
    for place, rule in enumerate(RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT r, {place} AS place, '{rule.kind}' AS kind, h, g, string_split_regex(t, {pattern}) AS gaps FROM"
            f" (SELECT r, t, regexp_extract_all(t, {pattern}, 0) AS h, regexp_extract_all(t, {pattern}, {rule.group}) AS g FROM d) WHERE len(h) > 0"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (SELECT r, place, kind, len(h[i]) AS n, len(g[i]) AS v,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS b FROM e),
k AS (SELECT r, place, b, kind || ':' || b || ':' || (b + n) AS span FROM s WHERE v >= CASE place {least} END),
a AS (SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
  string_agg(span, ',' ORDER BY b, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY b, place) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""


@query("op9_secret_scans", _sql())
def op9_secret_scans(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents"))

    def count(place: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")

    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(place).alias(f"n_{kind}") for place, kind in enumerate(BASE)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
