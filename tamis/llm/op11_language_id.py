"""Query: the language of all documents, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.llm.languages import identify, learn
from tamis.llm.registry import query, read

HELD_OUT = 2


def held_out(key: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("best").alias("lang_pred"), "score", "accepted")
