"""Ranked search against plain scoring: tiles, blocks, ties, nulls and empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import lexical_search
from tamis.llm.lexical_search import Best, score_tile, search, tiles

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    counts = [(key, Counter(plain_terms(text))) for key, text in docs]
    n = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for name, text in {(i, t) for i, t in items}:
        scored = []
        for key, c in counts:
            if not c:
                continue
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(name, rank, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def rows_of(frame):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "X-1"]
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 40)), p=share / share.sum()))) for i in range(400)]
    docs += docs[:90] + [(None, docs[3][1]), (None, None), (900, "")]  # copies tie
    items = [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 9))))) for i in range(30)]
    items += [items[0], (None, "w1 w2"), (99, ""), (98, None), (97, "nowhere"), (0, "w3 w4 w4")]
    return docs, items


@pytest.mark.parametrize("k, block", [(50, 8 << 20), (3, 8 << 20), (7, 400)])
def test_search(spark, corpus, k, block):
    docs, items = corpus
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(search(frame, wanted, k, block_bytes=block)) == plain_search(docs, items, k)


def test_odd_texts(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    items = [("a", "Shared1 shared2 WORD"), ("b", "exactly the same hunter2hunter2"), ("c", "中文 éß"), (None, "w1 w2 w3")]
    wanted = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as rank", "2L as score", "3L as doc_id", "4 as number")
    assert rows_of(search(odd, wanted)) == plain_search(docs, items, 50)
    assert search(none, wanted).count() == 0
    assert search(odd, wanted.limit(0)).count() == 0
    assert search(odd, none.selectExpr("doc_id as item_id", "text")).columns == ["item_id", "rank", "doc_id", "score"]


def test_products_stay_exact_where_weights_are_large():
    rng = np.random.default_rng(1)
    number, parts = tiles([b" ".join(b"t%d" % i for i in range(400))])
    w = rng.integers(1, 2**40, len(number))  # far beyond any corpus: a partial sum takes few columns
    term, doc = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(3)))
    impact = rng.integers(0, lexical_search.IMPACT, len(term)) // 1024
    expected = [sum(int(w[t]) * int(v) for t, d, v in zip(term, doc, impact) if d == at) for at in range(3)]
    assert score_tile(parts[0], w, term, doc, impact, 3).tolist() == [expected]


def test_ties_across_tiles_keep_the_smallest_ids():
    rng = np.random.default_rng(2)
    ids = rng.permutation(5000)
    scores = rng.integers(1, 4, 5000)
    best = Best(1, 20)
    for at in range(0, 5000, 37):
        best.offer(np.array([0]), scores[None, at : at + 37], ids[at : at + 37], np.zeros(len(ids[at : at + 37]), bool))
        if at % 5:
            best.settle()
    expected = sorted(zip((-scores).tolist(), ids.tolist()))[:20]
    assert [(-s, i) for _, s, i, _ in zip(*(x.tolist() for x in best.settle()))] == expected


def test_items_of_many_tiles(spark):
    items = [(i, f"t{i} t{i + 1} all") for i in range(3 * lexical_search.ITEM_TILE)]
    docs = [(i, f"t{i} all here") for i in range(0, 3 * lexical_search.ITEM_TILE, 5)]
    found = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert rows_of(found) == plain_search(docs, items, 4)
