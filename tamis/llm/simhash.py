"""Near duplicates by SimHash fingerprints, joined through fuzzy keys of the binary Golay code.

A fingerprint of 64 bits is cut into segments A, B (23 bits) and C (18 bits, filled up with zeros). The
perfect Golay code [23, 12] decodes any 23 bits to the one codeword within 3 flips. The keys of a segment
are the codewords of itself and of its 23 one-flip neighbours: 1 to 6 of them. Two segments at most 2
flips apart share a key; the plain codeword of one is among the keys of the other if they are at most
1 apart. Of 3 flips or fewer in a fingerprint

* one segment takes 2 or more: then another has none, and so one of (A exact, B fuzzy), (B exact, C fuzzy),
  (C exact, A fuzzy) has a key in common, or
* every segment takes at most 1: then (A fuzzy, B fuzzy, one half of C exact) has a key in common, where it
  is enough that one side brings its plain codewords.

Fingerprints that share a key are compared by their differing bits. Equal texts and equal fingerprints are
one row before this, so copies are no pairs. A key with more than ``BLOCK`` fingerprints is cut into blocks
whose pairs are compared in tasks of their own, each returning only a spanning forest of its links, so a
crowded key yields neither a large task nor a quadratic result, and no link between components is lost.

Defined cases: a null text is an empty one; texts without a word have fingerprint zero and are linked like
others; a null id is never the smallest unless a component has no other; repeated rows share a fingerprint;
an empty table gives an empty result. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.components import components
from tamis.session import cut_lineage

SEED = 42
FLIPS = 3
BLOCK = 1024  # fingerprints compared with as many in one task
MARKED = 1 << 18  # crowded keys sent to all tasks; there is one for more than BLOCK rows of keys
GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
CHUNK = 1 << 16
ROWS = 256  # texts or fingerprints handled together


def fingerprint(text: bytes, size: int = 3) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    shingles = [b" ".join(g) for g in zip(*(words[i:] for i in range(size)))] or [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint (long) of its texts. Row-local."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
                prints = pa.array([fingerprint(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], names=[*batch.schema.names[:-1], name])

    kept = [f for f in df.schema.fields if f.name != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` bigint"])
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text), F.lit("")).alias("_whole")).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def golay_decoder() -> np.ndarray:
    """The number of the nearest codeword of every 23-bit word."""
    data = np.arange(4096, dtype=np.int64)
    words = np.zeros(4096, np.int64)
    for bit in range(12):
        words ^= np.where(data >> bit & 1, GENERATOR << bit, 0)
    flips = [0]
    for n in range(FLIPS):
        flips += [f | 1 << b for f in flips if f.bit_count() == n for b in range(f.bit_length(), 23)]
    table = np.zeros(1 << 23, np.uint16)
    for flip in flips:
        table[words ^ flip] = data
    return table


def fuzzy(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments' keys: (row, key) of all, each once a row, and the plain codeword of each row."""
    table = golay_decoder()
    plain = table[segment]
    near = np.concatenate([plain[:, None], table[segment[:, None] ^ (1 << np.arange(23))]], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    row, at = np.nonzero(first)
    return row, near[row, at].astype(np.int64), plain.astype(np.int64)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, side): side 0 meets 0, and 1 (plain codewords) meets 2 (fuzzy ones)."""
    bits = prints.view(np.uint64)
    a, b, c = (((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    keyed = {name: fuzzy(x) for name, x in (("a", a), ("b", b), ("c", c))}
    keys, rows, sides = [], [], []

    def add(family: int, key: np.ndarray, row: np.ndarray, side: int) -> None:
        keys.append(key | family << 60)
        rows.append(row)
        sides.append(np.full(len(row), side, np.int8))

    for family, exact, other in ((0, a, "b"), (1, b, "c"), (2, c, "a")):
        row, key, _ = keyed[other]
        add(family, exact[row] << 12 | key, row, 0)
    every = np.arange(len(prints))
    (row_a, key_a, plain_a), (row_b, key_b, plain_b) = keyed["a"], keyed["b"]
    count_b = np.bincount(row_b, minlength=len(prints))
    start_b = np.cumsum(count_b) - count_b
    times = count_b[row_a]
    left = np.repeat(np.arange(len(row_a)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + start_b[row_a[left]]
    for half in (0, 1):
        part = (c >> 9 * half & 511) | half << 9
        add(3, (plain_a << 12 | plain_b) << 10 | part, every, 1)
        add(3, (key_a[left] << 12 | key_b[right]) << 10 | part[row_a[left]], row_a[left], 2)
    row = np.concatenate(rows)
    return np.concatenate(keys), prints[row], np.concatenate(sides)


def _keys_of(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4 * ROWS):
                key, value, side = fuzzy_keys(np.ascontiguousarray(values[at : at + 4 * ROWS], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(side)], names=["key", "fingerprint", "side"])

    return prints.select("fingerprint").mapInArrow(run, "key long, fingerprint long, side byte")


def forest(values: np.ndarray, flips: int = FLIPS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of at most ``flips`` differing bits connect: each value and its group's first."""
    bits = np.unique(values).view(np.uint64)
    linked = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= flips
    label = np.arange(len(bits))
    while True:
        least = np.where(linked, label[None, :], len(bits)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    signed, far = bits.view(np.int64), label != np.arange(len(bits))
    return signed[far], signed[label[far]]


def _forests(table: pa.Table) -> pa.Table:
    node, other = forest(table.column("fingerprint").to_numpy())
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64())})


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, other): links that connect the distinct fingerprints of ``prints`` as all pairs within 3 flips do."""
    # every fingerprint becomes some 75 rows: deal them to all tasks before, not after
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys_of(prints.repartition(tasks, "fingerprint"))
    crowded = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > block))
    # Spark sizes the keys by the fingerprints they are made of, and would send them to all tasks: joins name their kind
    marked = crowded.hint("broadcast" if crowded.count() <= MARKED else "merge")
    plain = keys.join(marked, "key", "left_anti")
    mine = plain.where("side < 2").select("key", F.col("fingerprint").alias("node"), "side")
    yours = plain.where("side != 1").select("key", F.col("fingerprint").alias("other"), F.col("side").alias("to"))
    met = mine.join(yours.hint("merge"), "key").where(
        (F.col("node") != F.col("other"))
        & (F.bit_count(F.col("node").bitwiseXOR(F.col("other"))) <= FLIPS)
        & F.when(F.col("side") == 0, (F.col("to") == 0) & (F.col("node") < F.col("other"))).otherwise(F.col("to") == 2)
    )
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    dealt = (
        keys.join(marked, "key")
        .select("key", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
        .select("key", "fingerprint", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    )
    split = dealt.groupBy("key", "low", "high").applyInArrow(_forests, "node long, other long")
    return met.select("node", "other").unionByName(split)


def _labels(printed: DataFrame, least: Column) -> DataFrame:
    """(fingerprint, component) for a table of fingerprints; component: the smallest ``least`` connected to it."""
    classes = cut_lineage(printed.groupBy("fingerprint").agg(F.min(least).alias("least")))
    roots = components(links(classes))
    named = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(smallest, "root").select("fingerprint", "component")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id: the smallest id connected to it."""
    printed = cut_lineage(with_fingerprint(df.select(F.col(key), F.col(text))).select(key, "fingerprint"))
    labels = _labels(printed, F.col(key)).withColumnRenamed("component", "component_id")
    return printed.join(labels, "fingerprint").select(key, "fingerprint", "component_id")


def _hashable(field: T.StructField) -> Column:
    """A column that can be hashed: one that holds a map or a variant as its JSON."""
    column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    if "map<" in kind or "variant" in kind:
        return F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"})
    return column


def first_of_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the smallest id (a null id last;
    of equal ids the smallest hash of all columns), and of equal rows one."""
    row = F.xxhash64(*[_hashable(f) for f in df.schema.fields])
    narrow = df.select(F.col(key).alias("_id"), row.alias("_row"), F.col(text).alias("_text"))
    printed = cut_lineage(with_fingerprint(narrow, "_text").select("_id", "_row", "fingerprint"))
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    labels = _labels(printed, first)
    chosen = labels.select("component").distinct().select(F.col("component.id").alias("_id"), F.col("component.row").alias("_row"))
    times = printed.groupBy("_id", "_row").agg(F.count("*").alias("_times"))
    same = chosen["_id"].eqNullSafe(times["_id"]) & (chosen["_row"] == times["_row"])
    kept = cut_lineage(chosen.join(times, same).select(chosen["_id"], chosen["_row"], "_times"))
    rows = df.withColumn("_of", row)
    on = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_row"))
    single = rows.join(kept.where("_times = 1"), on, "left_semi")
    repeated = rows.join(kept.where("_times > 1"), on, "left_semi").dropDuplicates([key, "_of"])
    return single.unionByName(repeated).drop("_of")
