"""All stages of the pipeline on nulls, odd texts, repeated rows, clashing names, maps, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def with_maps(df):
    tags = F.create_map(F.lit("a"), F.coalesce("doc_id", F.lit(0)), F.lit("b"), F.lit(None).cast("long"))
    return df.withColumn("tags", tags).withColumn("nested", F.struct(F.array("tags").alias("maps")))


def texts(df):
    return sorted((r["doc_id"] or -1, r["text"] or "") for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = with_maps(odd)
    out = stage(spark, wide, SMALL)
    assert stage(spark, with_maps(none), SMALL).count() == 0
    if name == "tokens":
        rows = out.collect()
        assert len(rows) == 15 and {r["n_tokens"] for r in rows if r["doc_id"] == 0} == {0}
        return
    assert out.columns == wide.columns and dict(out.dtypes) == dict(wide.dtypes)
    kept = out.collect()
    assert all(r["tags"]["a"] == (r["doc_id"] or 0) and r["tags"]["b"] is None for r in kept)
    before = texts(wide)
    if name == "quality":
        assert len(kept) <= len(before) and set(texts(out)) <= set(before)
    if name == "near_duplicates":
        ids = [r["doc_id"] for r in kept]
        assert len(ids) == len(set(ids)) and {0, 6, None} <= set(ids) and 7 not in ids
    if name == "decontaminate":
        assert texts(out) == before
    if name == "secrets":
        assert len(kept) == len(before) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)
        assert all("hunter2hunter2" not in (r["text"] or "") for r in kept)
