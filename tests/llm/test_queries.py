"""The registered queries against their SQL, and those without SQL against brute force, on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from oracle import compare, connect
from tamis.llm.bpe import Vocabulary, read_ranks
from tamis.llm.decontaminate import normalised
from tamis.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SMALL}/documents.parquet')").fetchall()
    return {key: text or "" for key, text in rows}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    ok, note = compare(spark, name, QUERIES[name], SQL[name], SMALL, connect(SMALL))
    assert ok, note


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int]) -> dict[int, int]:
    root = {key: key for key in prints}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {key: find(key) for key in keys}


def test_simhash(spark, documents):
    rows = QUERIES["op2_simhash_near_dedup"](spark, SMALL).collect()
    prints = {key: plain_fingerprint(text) for key, text in documents.items()}
    groups = plain_components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{p:016x}", groups[k]) for k, p in prints.items()}
    assert len(rows) == len(documents)


def plain_encoding():
    ranks = Vocabulary(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).ranks
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, documents):
    encoding = plain_encoding()
    for row in QUERIES["op4_byte_bpe"](spark, SMALL).collect():
        text = documents[row["doc_id"]]
        ids = encoding.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{folder}/labels.parquet')").fetchall())
    rows = QUERIES["op5_quality_classifier"](spark, folder).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([a for a, b in held if b == 1]) > 0.98


def test_decontamination_finds_exact_items(spark, documents):
    items = dict(duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SMALL}/benchmark.parquet')").fetchall())
    expected = {(k, i) for i, item in items.items() for k, text in documents.items() if normalised(item) in normalised(text)}
    rows = QUERIES["op6_qgram_decontamination"](spark, SMALL).collect()
    assert expected == {(r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0}
    for r in rows:
        assert 0 <= r["start"] < r["end"] <= len(normalised(documents[r["doc_id"]]))


def test_lm_base_scores_and_gain(spark):
    folder = "/root/testdata/sf0.01"
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{folder}/documents.parquet')").fetchall()
    tokens = {key: [*text.encode().lower().split(), None] for key, text in texts}
    held = {key: zlib.crc32(str(key).encode()) % 5 == 1 for key in tokens}
    counts = Counter(w for key, words in tokens.items() if not held[key] for w in words)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in QUERIES["op8_lm_scoring"](spark, folder).collect()}
    assert rows.keys() == tokens.keys()
    for key, words in tokens.items():
        r = rows[key]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[key], len(words), sum(w in counts for w in words), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())


def test_pipeline_stages_follow_their_operators(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        steps.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    raw, good, single, clean, masked = steps
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op5_quality_classifier"](spark, SMALL).collect()}
    assert good.keys() == {k for k, p in scores.items() if p == 1}
    groups = plain_components({k: plain_fingerprint(t) for k, t in good.items()})
    assert single.keys() == set(groups.values())
    items = [normalised(t) for (t,) in duckdb.sql(f"SELECT text FROM read_parquet('{SMALL}/benchmark.parquet')").fetchall()]
    assert not any(i in normalised(t) for i in items for t in clean.values())
    assert clean.keys() <= single.keys()
    spans = {r["doc_id"]: r for r in QUERIES["op9_secret_scans"](spark, SMALL).collect()}
    assert masked.keys() == clean.keys()
    assert all((masked[k] != clean[k]) == bool(spans[k]["spans"]) for k in masked)
    encoding = plain_encoding()
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == {k: encoding.encode_ordinary(t) for k, t in masked.items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]].encode()).hexdigest() for r in out)
