"""Query: benchmark items held by any document."""

from __future__ import annotations

from tamis.llm.decontaminate import find_leaks
from tamis.llm.registry import query, read


@query("op6_qgram_decontamination")
def op6_qgram_decontamination(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
