"""Query: all documents in shards 0 to 39, and where they go with one more shard."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.llm.registry import query, read
from tamis.llm.sharding import LEVELS, nodes, tree, with_shard, with_slots

SHARDS = 40


def _placed_sql(shards: int, name: str) -> str:
    """The shard of every distinct key, level by level."""
    out = f"{name}0 AS (SELECT DISTINCT k, '' AS at FROM d)"
    for i, level in enumerate(LEVELS):
        rows = ", ".join(
            f"('{parent}', '{path}', CAST({weight!r} AS DOUBLE))"
            for where, parent, path, weight, _ in nodes(tree(shards, SHARDS))
            if where == level
        )
        draw = "-ln((CAST('0x' || substr(md5(s.k || '@' || n.path), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / n.weight"
        out += (
            f", {name}{i + 1} AS (SELECT s.k, arg_min(n.path, {draw}) AS at FROM {name}{i} s"
            f" JOIN (VALUES {rows}) n(parent, path, weight) ON n.parent = s.at GROUP BY s.k)"
        )
    return out


# crc32 has no function in SQL: bits are folded in through the reflected table, built here by its rule
CRC_SQL = """crc_table AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i)),
crc_list AS (SELECT list(v ORDER BY i) AS crc_t FROM crc_table)"""

SQL = f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS t FROM documents),
bytes AS (SELECT doc_id, k, strlen(t) + 16 AS size, hex(encode(t)) AS h FROM d),
{_placed_sql(SHARDS, 'p')},
{_placed_sql(SHARDS + 1, 'q')},
crcs AS (SELECT doc_id, k, size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32 FROM bytes CROSS JOIN crc_list),
placed AS (SELECT c.doc_id, c.size, c.text_crc32, c.k, CAST(split_part(p3.at, '/', 3) AS INTEGER) AS shard, CAST(split_part(q3.at, '/', 3) AS INTEGER) AS grown_shard
  FROM crcs c JOIN p3 USING (k) JOIN q3 ON q3.k = c.k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""


@query("op10_tree_shards", SQL)
def op10_tree_shards(spark, sf_dir):
    """Law ``key``: document and shard count decide; shard 40 takes rows only into itself."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = with_shard(with_shard(docs, "doc_id", tree(SHARDS)), "doc_id", tree(SHARDS + 1, SHARDS), "grown_shard")
    slotted = with_slots(placed, "shard", "doc_id")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
