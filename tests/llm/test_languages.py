"""Language identification against plain compression, on odd texts, and on held-out documents."""

import zlib

import duckdb
import numpy as np
import xxhash
import zstandard

from tamis.llm import languages
from tamis.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_samples(rows, pieces=256, size=256):
    """The sample of each language, from all pieces of all texts at once."""
    held = {}
    for text, lang in rows:
        if text is None or lang is None:
            continue
        whole = languages.normalised(text)
        for at in range(0, len(whole), size):
            held.setdefault(lang, {})[xxhash.xxh64_intdigest(whole[at : at + size])] = whole[at : at + size]
    return {lang: b" ".join(found[h] for h in sorted(found)[:pieces]) for lang, found in held.items()}


def plain_sizes(samples, text, chunk=2048):
    out = {}
    for lang, sample in samples.items():
        words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False)
        words.precompute_compress(level=9)
        whole = languages.normalised(text)
        out[lang] = sum(len(packer.compress(whole[at : at + chunk])) for at in range(0, len(whole), chunk))
    return out


def held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 4 == 2


def test_query_equals_plain_compression(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{SMALL}/documents.parquet')").fetchall()
    samples = plain_samples([(t, lang) for k, t, lang in rows if not held_out(k)])
    texts = {k: t for k, t, _ in rows}
    found = QUERIES["op11_language_id"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        assert r["held_out"] == held_out(r["doc_id"])
        text = texts[r["doc_id"]]
        if not languages.LETTER.search(text or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        sizes = plain_sizes(samples, text)
        first, second = sorted(sizes.values())[:2]
        assert sizes[r["lang_pred"]] == first
        lead = (second - first) / second
        assert r["accepted"] == (lead >= 0.01)
        assert np.isclose(r["score"], lead / (lead + 0.01) if lead else 0.0, rtol=1e-12)


def test_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{MIDDLE}/documents.parquet')").fetchall())
    rows = [r for r in QUERIES["op11_language_id"](spark, MIDDLE).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["accepted"]]) > 0.98
    assert np.mean([r["accepted"] for r in rows]) > 0.95


def test_model_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    once, again = languages.learn(docs), languages.learn(docs.repartition(7))
    assert once == again and len(once.names) == 4 and once.names[0] == "en"
    assert all(len(s) <= 257 * 256 for s in once.samples)


def test_odd_texts(spark, odd, none):
    model = languages.learn(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = languages.identify(odd, model, keep=("doc_id", "lang")).collect()
    assert len(rows) == 15
    by_id = {r["doc_id"]: r for r in rows}
    for key in (0, 1, 2):  # null, empty, white space
        assert (by_id[key]["best"], by_id[key]["score"], by_id[key]["accepted"]) == ("und", 0.0, False)
    assert all(r["best"] in model.names and 0 <= r["score"] <= 1 for r in rows if r["doc_id"] not in (0, 1, 2))
    assert by_id[6][1:] == by_id[7][1:]
    assert languages.identify(none, model).count() == 0


def test_nothing_or_one_language_learned(spark, odd, none):
    nothing = languages.learn(none)
    assert nothing.names == [] and {r["best"] for r in languages.identify(odd, nothing).collect()} == {"und"}
    alone = languages.learn(odd)  # rows without a language are not learned from
    assert alone.names == ["en"]
    assert {r["best"] for r in languages.identify(odd, alone).collect()} == {"und", "en"}


def test_ties_go_to_the_more_frequent_language_and_are_rejected(spark):
    rows = [(0, "der die das", "de"), (1, "the of and", "en"), (2, "the of and", "en")]
    model = languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["en", "de"]
    assert languages.Judge(model).verdict("q") == ("en", 0.0, False)


def test_too_many_languages_are_refused(spark):
    frame = spark.createDataFrame([(i, "text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    try:
        languages.learn(frame, settings=languages.Settings(languages=4))
    except ValueError as refused:
        assert "4 languages" in str(refused)
    else:
        raise AssertionError("five languages were learned")


def test_long_texts_are_read_whole():
    model = languages.Model(["a", "b"], [b"alpha beta gamma delta " * 40, b"one two three four five " * 40])
    judge = languages.Judge(model)
    front = "alpha beta gamma delta " * 100
    assert judge.verdict(front)[0] == "a"
    assert judge.verdict(front + " ".join(f"one{i} two three{i} four five" for i in range(20_000)))[0] == "b"
