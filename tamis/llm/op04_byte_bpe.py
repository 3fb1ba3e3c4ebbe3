"""Query: all documents encoded to ids and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.bpe import encode, read_ranks
from tamis.llm.registry import query, read


def encoded_and_decoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """(kept columns, n_tokens, ids if wanted, ids_sha256, decoded_sha256)."""
    ranks = read_ranks(path)
    both = encode(docs, ranks, public_tokenizers.PATTERN, keep=keep, decoded="decoded")
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        *["ids"] * with_ids,
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    return encoded_and_decoded(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
