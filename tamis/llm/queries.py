"""All registered queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

from tamis.llm.registry import QUERIES, SQL

for _module in (
    "op01_quality_rules",
    "op02_simhash_near_dedup",
    "op03_substring_dedup",
    "op04_byte_bpe",
    "op05_quality_classifier",
    "op06_qgram_decontamination",
    "op07_license_scans",
    "op08_lm_scoring",
    "op09_secret_scans",
    "op10_tree_shards",
    "op11_language_id",
    "op12_lexical_search",
    "op13_source_divergence",
):
    import_module(f"tamis.llm.{_module}")

__all__ = ["QUERIES", "SQL"]
