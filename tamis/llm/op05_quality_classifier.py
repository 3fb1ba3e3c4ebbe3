"""Query: quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.quality_classifier import Model, remainder, score_documents, train
from tamis.llm.registry import query, read

THRESHOLD = 0.3
HELD_OUT = 0


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels.where(remainder(F.col("doc_id")) != HELD_OUT), "quality")


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, fitted(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
