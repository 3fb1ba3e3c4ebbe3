"""Query: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.llm.registry import query, read
from tamis.llm.simhash import near_duplicates


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
