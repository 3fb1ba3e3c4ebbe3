"""The audit of sources against plain sums over all terms."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.llm import divergence
from tamis.llm.divergence import audit, share, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least=3, listed=200):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = Counter()
    for lang in {r[0] for r in rows}:
        mine = [(s, t) for at, s, t in rows if at == lang]
        docs = Counter(t for _, terms in mine for t in set(terms))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {s: Counter() for s, _ in mine}
        for s, terms in mine:
            counts[s].update(t for t in terms if docs[t] >= least)
        total = sum(counts.values(), Counter())

        def shares(c):
            size = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out.update((lang, s, "pair", name, -v, i) for i, (v, _, name) in enumerate(sorted(pairs), 1))
            out.update((lang, s, "term", name, -v, i) for i, (v, _, name) in enumerate(sorted(terms)[:listed], 1))
    return out


def rows_of(frame):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    words = [f"wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80)] + ["É", "中文", "x9y", "Zwei-Teile"]
    weight = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=weight / weight.sum())) for _ in range(150)]
    rows = [(["en", "de", None][i % 3], [f"s{i % 7}", None, ""][0 if i % 5 else i % 3], t) for i, t in enumerate(texts)]
    rows += [("en", f"s{i % 4}", texts[0]) for i in range(200)]  # one text holds half of the language
    rows += [("en", "silent", None), ("en", "silent", "12 34"), ("xx", "a", "only once"), ("xx", "b", "other words"), (None, None, None)]
    return rows


def test_audit(spark, corpus):
    frame = spark.createDataFrame(corpus, "lang string, source string, text string")
    assert rows_of(audit(frame.repartition(5))) == plain_audit(corpus)
    assert rows_of(audit(frame.repartition(1), least=1, listed=2)) == plain_audit(corpus, 1, 2)


def test_groups_that_are_not_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL_BYTES", 0)
    frame = spark.createDataFrame(corpus, "lang string, source string, text string")
    assert rows_of(audit(frame.repartition(3))) == plain_audit(corpus)


def test_odd_texts(spark, odd, none):
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert rows_of(audit(odd)) == plain_audit(rows)
    assert rows_of(audit(odd, least=1)) == plain_audit(rows, 1)
    assert audit(none).count() == 0
    assert audit(none).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_texts_are_counted_by_their_copies(spark):
    rows = [("en", "a", "one two two")] * 5 + [("en", "b", "one two two")] * 2 + [("de", "a", "one two two")]
    counted = term_counts(spark.createDataFrame(rows, "lang string, source string, text string"))
    sums = {(r[0], r[1], r[2]): (r[3], r[4]) for r in counted.groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()}
    assert sums == {
        ("en", "a", "one"): (5, 5), ("en", "a", "two"): (10, 5), ("en", "b", "one"): (2, 2), ("en", "b", "two"): (4, 2),
        ("de", "a", "one"): (1, 1), ("de", "a", "two"): (2, 1),
    }


def test_shares_are_exact(spark):
    cases = [(0, 1), (0, 3), (6, 7), (10**13, 3 * 10**13 + 7), (9 * 10**15 - 1, 9 * 10**15), (123456789012, 987654321098)]
    frame = spark.createDataFrame(cases, "c long, s long")
    got = [r[0] for r in frame.select(share(F.col("c"), F.col("s"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // s for c, s in cases]


def test_common_terms_do_not_depend_on_batches_or_cells(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("en", f"t{t:03}", f"s{s}", int(rng.integers(1, 10**6)), 1 + s) for t in range(60) for s in range(9) if rng.random() < 0.6]
    table = pa.table(dict(zip(("lang", "term", "source", "p", "floor"), map(list, zip(*rows)))))

    def sums(size):
        out = Counter()
        for batch in divergence._common(iter(table.to_batches(max_chunksize=size))):
            for r in batch.to_pylist():
                out[r["source"], r["item"]] += r["value"]
        return out

    whole = sums(len(rows))
    assert sums(1) == sums(7) == whole and len(whole) == 72
    monkeypatch.setattr(divergence, "CELLS", 10)
    assert sums(50) == whole
