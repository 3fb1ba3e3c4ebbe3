"""Query: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.llm.context_mixing import score_texts
from tamis.llm.registry import query, read

HELD_OUT = 1


@query("op8_lm_scoring")
def op8_lm_scoring(spark, sf_dir):
    scored = score_texts(read(spark, sf_dir, "documents"), remainder=HELD_OUT)
    return scored.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )
