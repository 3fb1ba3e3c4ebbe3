"""Nulls, empty and long texts, repeated rows, clashing column names and empty tables, for every operator."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tamis.llm import bpe, context_mixing, decontaminate, licenses, quality_classifier, quality_rules, secrets, sharding, simhash, substrings
from tamis.llm.components import components

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def texts_of(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]


def test_quality_rules(odd, none):
    rows = quality_rules.judge_documents(odd, cleaned=True).collect()
    assert len(rows) == 15 and quality_rules.judge_documents(none).count() == 0
    assert sorted(r["n_words"] for r in rows) == sorted(len(t.encode().split()) for _, t in texts_of(odd))
    empty = [r for r in rows if r["n_words"] == 0]
    assert len(empty) == 3 and all(r["base_failed"] and not r["kept"] and r["clean_text"] == "" for r in empty)
    assert [r["n_boilerplate"] for r in rows if r["doc_id"] == 11] == [2]


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 15 and simhash.near_duplicates(none).count() == 0
    assert {r["component_id"] for r in rows if r["fingerprint"] == 0} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    kept = simhash.first_of_groups(odd)
    assert kept.columns == odd.columns and simhash.first_of_groups(none).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in rows if r["component_id"] is not None})
    assert ids.count(None) == 1


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(7)
    near = [0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for _ in range(500)]
    far = rng.integers(-(2**62), 2**62, 200).tolist()
    prints = spark.createDataFrame([(int(x),) for x in {*near, *far}], "fingerprint long")
    split = {tuple(r) for r in components(simhash.links(prints, block=16)).collect()}
    whole = {tuple(r) for r in components(simhash.links(prints)).collect()}
    assert split == whole and len(split) >= len(set(near))


@pytest.mark.parametrize("marked", [0, simhash.MARKED])
def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch, marked):
    """A fingerprint becomes some 75 rows of keys, which Spark doesn't know when it sizes them."""
    monkeypatch.setattr(simhash, "MARKED", marked)
    rng = np.random.default_rng(7)
    near = {0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(62, 2, replace=False)) for _ in range(100)}
    prints = spark.createDataFrame([(int(x),) for x in {*near, *rng.integers(-(2**62), 2**62, 200).tolist()}], "fingerprint long")
    found = simhash.links(prints, block=16)
    assert found.count() == len(found.collect()) >= len(near) - 1  # the rows of the plan below were taken
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    assert any("SortMergeJoin" in line for line in lines) and any("MapInArrow" in line for line in lines)
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("MapInArrow" in inner for inner in lines[i:below])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    rows = components(spark.createDataFrame(chain, "node int, other int")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "node int, other int")).count() == 0


def plain_removal(texts: list[str], size: int) -> list[tuple[int, int, str]]:
    words = [t.encode().split() for t in texts]
    counts: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - size + 1):
            counts[tuple(w[i : i + size])] = counts.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size", [8, 35])
def test_substrings(odd, none, size):
    rows = substrings.remove_repeats(odd, size=size).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == sorted(plain_removal([t for _, t in texts_of(odd)], size))
    assert substrings.remove_repeats(none, size=size).count() == 0


def test_substrings_of_repetitive_texts(spark):
    texts = ["a " * 500, "a " * 300 + "b", "x y " * 200, " ".join(map(str, range(200))), " ".join(map(str, range(50, 120)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substrings.remove_repeats(frame).collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sorted(rows)] == plain_removal(texts, 35)


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "_mixed", lambda x: np.zeros_like(x))
    strings = [b"a b c d", b"a b c e", b"x a b c", b"p q r", b"p q r"]
    distinct, masks = substrings.repeated_windows(strings, 3)
    assert dict(zip(distinct, masks.tolist())) == {b"a b c d": 1, b"a b c e": 1, b"x a b c": 2, b"p q r": 1}


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ACGT", "a"])
def test_bpe_of_very_long_words(letters):
    words = bpe.Vocabulary(RANKS)
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    for seed in range(3):
        long = "".join(random.Random(seed).choices(letters, k=200_000))
        start = time.process_time()
        ids, counts = words.replay([b"short", long.encode(), b""])
        assert time.process_time() - start < 10  # quadratic work would take many minutes
        want = encoding.encode_ordinary(long)
        assert counts.tolist() == [1, len(want), 0] and ids[1:].tolist() == want
        assert words.encode_word(long.encode()) == want


def test_bpe(odd, none):
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS).ranks, special_tokens={})
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang"))
    rows = bpe.decode(encoded, RANKS).collect()
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in rows) == sorted(
        (str(k), encoding.encode_ordinary(t), t.encode()) for k, t in texts_of(odd)
    )
    once = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang"), decoded="decoded").collect()
    assert sorted(map(str, once)) == sorted(map(str, rows))
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert bytes(bpe.decode(odd.selectExpr("cast(null as array<int>) as ids").limit(1), RANKS).first()["decoded"]) == b""


def replayed(vocabulary, words):
    ids, sizes = vocabulary.replay(words)
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]


def test_replay_is_word_by_word():
    rng = np.random.default_rng(5)
    vocabulary = bpe.vocabulary(RANKS)
    short = [t for t in vocabulary.tokens if 1 < len(t) < 5]
    words = [b"".join(short[i] for i in rng.integers(0, len(short), int(rng.integers(0, 6)))) for _ in range(4000)] + [b"a" * 99, b""]
    assert replayed(vocabulary, words) == [vocabulary.encode_word(w) for w in words]


def test_replay_mends_words_whose_merges_make_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"xyx": 256, b"xy": 257, b"xyxy": 258}
    vocabulary = bpe.Vocabulary(b"\n".join(bpe.base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    words = [b"xyxy"] * 30 + [b"xyxyxy", b"xxy"]
    assert replayed(vocabulary, words) == [vocabulary.encode_word(w) for w in words]


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(odd, labels, "quality")
    rows = quality_classifier.score_documents(odd, model).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.score_documents(none, model).count() == 0
    untrained = quality_classifier.train(odd, labels.where("quality > 5"), "quality")
    assert {r["score"] for r in quality_classifier.score_documents(odd, untrained).collect()} == {0.5}
    single = quality_classifier.train(odd, labels.where("quality = 1"), "quality")
    assert all(r["score"] > 0.5 for r in quality_classifier.score_documents(odd, single).collect())
    assert quality_classifier.keep_good(odd, single, 0.3).columns == odd.columns


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    rows = rng.random((4000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(rows[:3000], labels[:3000])
    assert np.mean((model.score(rows[3000:]) > 0.5) == labels[3000:]) > 0.9


def edit_distance_within(item: str, text: str) -> int:
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, f"Words in front {decontaminate.normalised('shared0 shared1 shared2 shared3 shared4 shared5')}"), (2, None), (3, ""), (4, "MIT"), (4, "MIT")],
        "item_id long, text string",
    )
    rows = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_leaks(odd, bench).collect()}
    assert rows == {(9, 1, 0), (11, 4, 0)}
    in_blocks = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_leaks(odd, bench, block=80).collect()}
    assert in_blocks == rows
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.where("item_id > 9")).count() == 0
    clean = decontaminate.without_leaks(odd, bench, block=80)
    assert clean.columns == odd.columns and clean.count() == 13


def test_edited_items_are_found_up_to_the_budget():
    rng = np.random.default_rng(11)
    letters = "abcdefgh "
    item = decontaminate.normalised("".join(rng.choice(list(letters + "ijklmnop"), 150)))
    index = decontaminate.Index([(1, item)], decontaminate.Q, decontaminate.RATE)
    budget = index.items[0].budget
    for n in range(60):
        chars = list(item)
        for _ in range(n % (budget + 4)):
            k, kind = int(rng.integers(len(chars))), rng.integers(3)
            chars[k : k + (kind < 2)] = [] if kind == 0 else [str(rng.choice(list(letters)))]
        text = decontaminate.normalised("q r s t u v " + "".join(chars) + " v u t s r q")
        found, distance = list(decontaminate.search(index, [text])), edit_distance_within(item, text)
        assert bool(found) == (distance <= budget)
        if found:
            _, _, start, end, edits = found[0]
            assert edits == distance == edit_distance_within(item, text[start:end])


def test_licenses(odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 15 and licenses.scan(none).count() == 0
    assert {r["doc_id"]: [m["license"] for m in r["licenses"]] for r in rows if r["licenses"]} == {11: ["MIT"]}


def test_license_sizes_lose_nothing():
    for size in range(1, 60):
        for other in range(1, 120):
            if 2 * min(size, other) / (size + other) >= 0.8:
                assert other in licenses.admitted(size, 0.8)


def test_licenses_inside_longer_texts(spark):
    mit = next(t.text for t in licenses.TEMPLATES if "hereby granted" in t.text)
    first, rest = mit.split(" The above copyright")
    second, third = rest.split(" THE SOFTWARE IS PROVIDED")
    notice = [first, "The above copyright" + second, "THE SOFTWARE IS PROVIDED" + third]
    words = (" ".join(notice)).split()
    prose = " ".join(f"w{i * i % 97}" for i in range(300))
    comment = "\n".join(["/*"] + [" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)] + [" *", " */", prose])
    texts = {
        1: "\n\n".join([prose, *notice, prose]),
        2: comment,
        3: "All code here is by the authors. This work is licensed under the GNU General Public License, version 3.",
        4: f"{prose} Released under the MIT License. {prose}",
        5: f"{prose}\n\n{notice[0]}\n\n{prose}",
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: {m["license"]: m["dice"] for m in r["licenses"]} for r in licenses.scan(frame).collect()}
    assert found == {1: {"MIT": 1.0}, 2: {"MIT": 1.0}, 3: {"GPL-3.0": 1.0}, 4: {"MIT": 1.0}, 5: {}}


def test_license_windows_equal_all_windows(spark):
    templates = (licenses.Template("A", "a b c d e a b"), licenses.Template("B", "b a b c"), licenses.Template("C", "e d c b a x y z"))
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(list("abcdexyzq"), size=int(rng.integers(0, 26)), p=[0.2, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05, 0.1]))) for i in range(300)]
    expected = {}
    for key, text in texts:
        words, best = text.split(), {}
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                grams = set(zip(words[i:j], words[i + 1 : j]))
                for t in templates:
                    other = set(zip(t.text.split(), t.text.split()[1:]))
                    dice = 2.0 * len(grams & other) / (len(grams) + len(other))
                    if dice >= 0.8:
                        best[t.license] = max(best.get(t.license, 0), dice)
        expected[key] = best
    rows = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), templates=templates).collect()
    assert {r["doc_id"]: {m["license"]: m["dice"] for m in r["licenses"]} for r in rows} == expected
    assert sum(map(len, expected.values())) > 30


def test_secrets(odd, none):
    rows = {r["id"]: r for r in secrets.scan(odd).collect()}
    assert secrets.scan(odd).count() == 15 and secrets.scan(none).count() == 0
    (span,) = rows[6]["spans"]
    assert rows[6]["text"][span["start"] : span["end"]] == "password: hunter2hunter2."
    masked = secrets.redact(odd)
    assert masked.columns == odd.columns and masked.where("text IS NULL").count() == 1
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[7].endswith("with a password: [SECRET]") and texts[5] == dict(texts_of(odd))[5]


def test_private_keys_are_masked_whole(spark):
    lines = [hashlib.sha512(bytes([i])).hexdigest().upper() for i in range(3)]
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + "\r\n".join(lines) + "\n-----END RSA PRIVATE KEY-----"
    texts = {1: f"é before\n{key}\nbetween\n{key}", 2: key, 3: "cut: " + key[: key.index("\n-----END")], 4: key.replace("\n", "\\n") + " after", 5: "no key"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(frame).collect()}
    assert masked == {1: "é before\n[SECRET]\nbetween\n[SECRET]", 2: "[SECRET]", 3: "cut: [SECRET]", 4: "[SECRET] after", 5: "no key"}
    rows = {r["id"]: r for r in secrets.scan(frame).collect()}
    assert [rows[1]["text"][s["start"] : s["end"]] for s in rows[1]["spans"]] == [key, key]


def test_overlapping_secrets_become_one_mask(spark):
    text = 'x token = "' + "ab12" * 10 + '" y AKIA' + "Z9" * 8 + " secret: short AKIA12"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(frame).first()["text"] == 'x token = "[SECRET]" y [SECRET] secret: short AKIA12'


def test_trigram_queries_are_necessary():
    import re

    samples = ["my api-key", "APIKEY = abcdefgh1", "api_key: 'abcdefgh1'", "Passwd=12345678", "AKIA" + "A" * 16, "ghp_" + "a" * 36, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----"]
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in samples:
            if query is not None and re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in a) for a in query), (rule.kind, text)
    assert secrets.trigram_query("[0-9a-f]{32,}") is None
    assert secrets.trigram_query("abcd(e|f)?") == [frozenset({"abc", "bcd"})]


def test_lm(odd, none):
    rows = context_mixing.score_texts(odd).collect()
    assert len(rows) == 15 and context_mixing.score_texts(none).count() == 0
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(t.encode().lower().split()) + 1 for _, t in texts_of(odd))
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in rows)
    untaught = context_mixing.score_texts(odd.where("doc_id = 4").limit(1), remainder=int(__import__("zlib").crc32(b"4") % 5)).first()
    assert untaught["train_tokens"] == 0 and untaught["n_known"] == 0 and np.isfinite(untaught["score"])


def test_lm_word_numbers_do_not_wrap():
    for ids in ([], [0, 1, 65536, (1 << 24) - 1], [3, 1 << 24, (1 << 24) + 70000, (1 << 31) - 1]):
        assert context_mixing._unpacked(context_mixing._packed(np.array(ids, np.int64))).tolist() == ids


def test_lm_blocks_close_after_the_document_that_fills_them(spark, monkeypatch):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(20)), True) for i in range(10)]
    frame = spark.createDataFrame(rows, "id long, text string, training boolean").coalesce(1)
    monkeypatch.setattr(context_mixing, "BLOCK_WORDS", 30)
    blocks = context_mixing._blocks(frame, "bigint").where("word IS NULL").groupBy("block").count().collect()
    assert sorted(r["count"] for r in blocks) == [2] * 5


def test_mixer_is_a_distribution():
    counts = np.ones(256, np.int64)
    counts[:200] = 0
    tree = context_mixing.huffman(counts * 50)
    table = np.random.default_rng(1).integers(0, 30, (context_mixing.SLOTS, 2)).astype(np.float32)
    model = context_mixing.Model(tree, table, context_mixing.initial_weights())
    ends = model.log_probabilities([b""])[0]
    starts = [bytes([b]) for b in range(256) if b != 0x20]
    # first bytes and the closing byte share the whole: code each first byte alone by removing its closing byte's cost
    owner, bit, slots = context_mixing.decisions(starts, tree)
    total = context_mixing.mixed(model.stretched[slots], model.weights, model.levels[slots[-1]])
    logs = -np.logaddexp(0, np.where(bit == 1, -total, total))
    sizes = tree.sizes[np.frombuffer(b"".join(starts), np.uint8)]
    first = [logs[owner == i][: sizes[i]].sum() for i in range(len(starts))]
    assert abs(np.exp(first).sum() + np.exp(ends) - 1) < 1e-5


def test_shards(spark, odd, none):
    leaves = sharding.tree(40)
    placed = sharding.with_slots(sharding.with_shard(odd.select("doc_id", "text"), "doc_id", leaves), "shard", "doc_id", group=2)
    rows = placed.collect()
    assert len(rows) == 15
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.with_slots(sharding.with_shard(none.select("doc_id"), "doc_id", leaves), "shard", "doc_id").count() == 0


def test_shards_move_only_where_weights_change(spark):
    leaves = sharding.tree(40)
    heavier = sharding.reweighted(leaves, 13, 3.0)
    frame = spark.range(6000).withColumnRenamed("id", "doc_id")
    both = sharding.with_shard(sharding.with_shard(frame, "doc_id", leaves), "doc_id", heavier, "other")
    grown = sharding.with_shard(both, "doc_id", sharding.tree(42, 40), "more")
    rows = sharding.with_shard(grown, "doc_id", sharding.tree(41, 40), "one").collect()
    place = {leaf.shard: leaf for leaf in leaves}
    for r in rows:
        a, b = place[r["shard"]], place[r["other"]]
        if r["shard"] != r["other"]:  # a row that moves enters the heavier region or moves to the heavier rack or shard within it
            assert b.region == place[13].region
            assert a.region != b.region or b.rack == place[13].rack and (a.rack != b.rack or b.shard == 13)
        assert r["one"] == r["shard"] or r["one"] == 40
        assert r["more"] == r["one"] or r["more"] == 41
    counts = np.bincount([r["shard"] for r in rows], minlength=40)
    assert counts.min() > 90 and counts.max() < 220


def test_lm_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, *others = ({r["doc_id"]: r["score"] for r in context_mixing.score_texts(d).collect()} for d in (docs, docs.repartition(7), docs.repartition(3)))
    for other in others:
        assert other == pytest.approx(first, rel=1e-9)
