"""How far the sources of a language lie apart, by the terms they use.

1. Equal texts of a language are collapsed: one row per text with its number of rows in every source. Tasks collapse
   what they read before the shuffle, so a text that a third of all rows hold is sent once by each task.
2. Every text is split into terms once; counts and document frequencies are added by its multiplicities.
3. Terms in at least ``least`` documents of the language are kept, as one row with the counts of the sources that
   hold them.
4. Pairs of sources are evaluated sparsely. A term that a source lacks has the source's floor there, so the sum over
   all terms is (terms) x (floors of both), plus a correction for the terms of one source against the floor of the
   other, plus one for the terms that both hold. Corrections against a floor depend on the count alone and are
   summed over a histogram of counts; only terms that both sources hold are looked at pair by pair, in their own row.

All arithmetic is on whole numbers. Shares are per 10^9: p = 1 + floor(10^9 (count + 1) / (N + V)), N the source's
occurrences of kept terms and V the number of kept terms of the language; exact up to N + V = 9 x 10^15. The distance
of a source from another is the sum of floor((p - q)^2 / q), q the other's share.

Defined results: null texts, languages and sources are ''. A source without terms takes part; where a language keeps
no term, all values are 0 and no term is listed. Equal values go by name, as UTF-8. Empty tables give no row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tables import stored

HELD_BYTES = 16 << 20  # of texts that a task collapses at a time
HELD_TERMS = 300_000  # of terms and sources that a task counts at a time
CELLS = 1 << 20  # pairs of sources evaluated at a time
SMALL_BYTES = 8 << 20  # of groups that are broadcast at most; more are joined by shuffle

# terms are runs of ASCII letters and of anything beyond ASCII; A-Z are lower-cased
_APART = bytes(c for c in range(128) if not chr(c).isalpha())
_TERMS = bytes.maketrans(_APART + bytes(range(65, 91)), b" " * len(_APART) + bytes(range(97, 123)))

COLLAPSED = "lang string, digest binary, text binary, sources array<string>, times array<long>"
COUNTED = "lang string, source string, term string, n long, docs long"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, bytes], tuple[bytes, Counter]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        columns = [
            pa.array([lang for lang, _ in held], pa.string()),
            pa.array([digest for _, digest in held], pa.binary()),
            pa.array([text for text, _ in held.values()], pa.binary()),
            pa.array([list(times) for _, times in held.values()], pa.list_(pa.string())),
            pa.array([list(times.values()) for _, times in held.values()], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "digest", "text", "sources", "times"])

    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            key = (lang, hashlib.md5(text).digest())
            if key not in held:
                held[key] = (text, Counter())
                size += len(text) + 200
            held[key][1][source] += 1
            if size > HELD_BYTES:
                yield flush()
                held.clear()
                size = 0
    if held:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (lang, digest, text): equal ones are joined, split into terms once and added up."""
    counts: dict[tuple[str, str], dict[bytes, int]] = {}
    documents: dict[tuple[str, str], dict[bytes, int]] = {}
    last: tuple | None = None
    times: Counter = Counter()

    def add() -> None:
        terms = Counter(last[2].translate(_TERMS).split())
        for source, m in times.items():
            n, d = counts.setdefault((last[0], source), {}), documents.setdefault((last[0], source), {})
            for term, c in terms.items():
                n[term] = n.get(term, 0) + m * c
                d[term] = d.get(term, 0) + m

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            if n:
                d = documents[lang, source]
                columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()).view(pa.string())]
                columns += [pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        documents.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if last is None or row[:3] != last[:3]:
                if last is not None:
                    add()
                    if sum(map(len, counts.values())) > HELD_TERMS:
                        yield from flush()
                last, times = row, Counter()
            times.update(dict(zip(row[3], row[4])))
    if last is not None:
        add()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of a table (lang, source, text) without nulls; parts of sums, to be added up."""
    collapsed = docs.select("lang", "source", "text").mapInArrow(_collapse, COLLAPSED)
    met = collapsed.repartition("lang", "digest").sortWithinPartitions("lang", "digest", "text")
    return met.mapInArrow(_count, COUNTED)


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / size), three digits at a time so that no product leaves 64 bits."""
    out, rest = F.lit(1).cast("long"), count + 1
    for unit in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out = out + _div(rest, size) * unit
        rest = rest % size
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _np_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): corrections for terms that both sources hold, of rows in order of (lang, term)."""
    number: dict[tuple[str, str], int] = {}
    sums: dict[tuple[int, int], int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if sums:
            names = list(number)
            left, right = zip(*sums)
            columns = [pa.array([names[a][0] for a in left]), pa.array([names[a][1] for a in left]), pa.array([names[b][1] for b in right])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])
            sums.clear()

    def evaluate(code: np.ndarray, p: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All three: terms by the k sources that hold each."""
        k = code.shape[1]
        many, rows = max(1, CELLS // (k * k)), max(1, min(k, CELLS // k))
        for at in range(0, len(code), many):
            b, q, q0 = (x[at : at + many, None, :] for x in (code, p, floor))
            for first in range(0, k, rows):
                a, r, r0 = (x[at : at + many, first : first + rows, None] for x in (code, p, floor))
                extra = _np_distance(r, q) - _np_distance(r, q0) - _np_distance(r0, q) + _np_distance(r0, q0)
                pair = a * len(number) + b
                found, where = np.unique(pair, return_inverse=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, where.ravel(), extra.ravel())
                for key, value in zip(found.tolist(), total.tolist()):
                    x, y = divmod(key, len(number))
                    if x != y:
                        sums[x, y] = sums.get((x, y), 0) + value
                if len(sums) > CELLS:
                    yield from flush()

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Terms whose rows are all in ``table``."""
        langs, sources = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        names = [(a, b) for a in langs.dictionary.to_pylist() for b in sources.dictionary.to_pylist()]
        mine = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        met, back = np.unique(mine, return_inverse=True)
        code = np.array([number.setdefault(names[i], len(number)) for i in met.tolist()], np.int64)[back]
        p, floor = (table.column(c).to_numpy() for c in ("p", "floor"))
        starts = np.flatnonzero(_starts(table))
        sizes = np.diff(np.append(starts, len(code)))
        for k in np.unique(sizes).tolist():
            if k > 1:
                at = starts[sizes == k][:, None] + np.arange(k)
                yield from evaluate(code[at], p[at], floor[at])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if table.num_rows:
            last = int(np.flatnonzero(_starts(table))[-1])
            yield from whole(table.slice(0, last)) if last else ()
            rest = table.slice(last)
    if rest is not None:
        yield from whole(rest)
    yield from flush()


def _starts(table: pa.Table) -> np.ndarray:
    """True where a row has another (lang, term) than the row before."""
    out = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        moved = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (table.column("lang").combine_chunks(), table.column("term").combine_chunks())]
        out[1:] = pc.or_(*moved).to_numpy(zero_copy_only=False)
    return out


def audit(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, listed: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank) per language and source.

    Part ``pair``: the distance of the source from every other source of the language, all of them. Part ``term``:
    the ``listed`` terms whose share lies furthest above that of the whole language.
    """
    docs = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    # rows of one term meet by (lang, term): the sums by source need no further shuffle
    added = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = added.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = stored(by_term.where(F.col("docs") >= least).drop("docs"))
    flat = kept.select("lang", "term", "total", F.explode("held").alias("held")).select("lang", "term", "total", "held.source", "held.n")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    every = docs.select("lang", "source").distinct()
    joined = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    counted = joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "terms", "all")])
    floor = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.greatest(F.col("size") + F.col("terms"), F.lit(1).cast("long"))))
    groups = stored(counted.withColumn("floor", floor))
    bulk = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    small = bulk <= SMALL_BYTES
    table = F.broadcast(groups) if small else groups

    # one row per term and source that holds it, in the order of terms
    shares = flat.join(table, ["lang", "source"]).select(
        "lang",
        "term",
        "source",
        "n",
        "terms",
        "floor",
        share(F.col("n"), F.col("size") + F.col("terms")).alias("p"),
        share(F.col("total"), F.col("all") + F.col("terms")).alias("q"),
    )
    ordered = shares if small else shares.repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = ordered.select("lang", "term", "source", "p", "floor").mapInArrow(_common, "lang string, source string, item string, value long")

    others = (groups if not small else F.broadcast(groups)).select("lang", F.col("source").alias("other"), F.col("floor").alias("other_floor"))
    counts = shares.groupBy("lang", "source", "p", "floor").agg(F.count("*").alias("m"))
    facing = counts.join(others, "lang").where(F.col("source") != F.col("other"))
    p, own, theirs = F.col("p"), F.col("floor"), F.col("other_floor")
    there = F.struct(F.col("source"), F.col("other").alias("item"), (F.col("m") * (distance(p, theirs) - distance(own, theirs))).alias("value"))
    back = F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("m") * (distance(theirs, p) - distance(theirs, own))).alias("value"))
    single = facing.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")
    floors = (
        groups.join(others, "lang")
        .where(F.col("source") != F.col("other"))
        .select("lang", "source", F.col("other").alias("item"), F.coalesce(F.col("terms") * distance(own, theirs), F.lit(0).cast("long")).alias("value"))
    )
    pairs = floors.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    above = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    top = above.withColumn("rank", rank).where(F.col("rank") <= listed).withColumn("part", F.lit("term"))
    return ranked.unionByName(top).select("lang", "source", "part", "item", "value", "rank")
