"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a table with the
columns of documents; the last returns token ids. ``run`` writes each stage as Parquet into the shared folder and
reads it again for the next.

1. ``quality``: documents that the classifier rejects go.
2. ``near_duplicates``: of each group of near duplicates the document with the smallest id stays.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``secrets``: the values of secrets are masked; ``n_chars`` follows the text.
5. ``tokens``: texts become ids, and the ids are decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.decontaminate import without_leaks
from tamis.llm.op04_byte_bpe import encoded_and_decoded
from tamis.llm.op05_quality_classifier import THRESHOLD, fitted
from tamis.llm.quality_classifier import keep_good
from tamis.llm.registry import read
from tamis.llm.secrets import redact
from tamis.llm.simhash import first_of_groups
from tamis.llm.tables import stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; a null text is judged as an empty one."""
    return keep_good(docs, fitted(docs, read(spark, sf_dir, "labels")), THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a word are one group, like any texts with equal fingerprints."""
    return first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no item and stay; an empty benchmark keeps all documents."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; a null text stays null, with a null ``n_chars``."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256); a null text has no ids."""
    return encoded_and_decoded(docs, VOCABULARY, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
