"""Substring dedup by super-k-mers: words covered by a window that also starts elsewhere are removed.

A window is ``size`` consecutive words of one document. Its minimiser is the smallest of its runs of
``MER`` words under a fixed order. Consecutive windows with one minimiser travel together as one packed
string, a super-k-mer, to the bucket of the minimiser. Equal windows have equal minimisers, so a bucket
sees all copies of its windows; it sorts their hashes and compares the words of those that agree.

1. ``_frequent`` counts the runs of words in a fixed number of slots, and the order puts runs of crowded
   slots last. A window that holds any rare run is then placed by it, so a passage shared by many documents
   draws to its bucket only the windows that lie in the passage as a whole.
2. ``_super_kmers`` packs each task's super-k-mers by bucket, compressed; a string is sent at most twice by
   a task, which is all that counting to two needs. Hot passages and groups of copies shrink before the
   shuffle, whatever share of the rows they are.
3. ``_repeated`` returns, per distinct string, a mask of the windows that occur twice or more.
4. The strings of each document (128-bit digests) are joined with the masks, and the covered words removed.

Windows are judged on the input. No limit drops a window; a run is cut after 64 windows to fit its mask.

Defined cases: a null text is an empty one; fewer words than ``size`` remove nothing; a repeated row is two
documents, so all windows of both occur twice; rows with one id are told apart by their text; an empty table
gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import cut_lineage

SIZE = 35
MER = 5
RUN = 64  # windows of a super-k-mer, at most: the bits of its mask
SLOTS = 1 << 16
CROWDED = 1.5  # times the mean of a slot
CHUNK = 1 << 20  # bytes of text whose words are in memory at a time
PACKED = 16 << 20  # bytes of super-k-mers that a task packs together
BUCKETS_PER_PARTITION = 8
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Spans:
    """64-bit hashes of any spans of a byte string, from prefix sums: an odd base can be divided by modulo 2**64."""

    values = _mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        if len(raw) >= len(_Spans.powers):
            size = len(raw) + (1 << 20)
            _Spans.powers, _Spans.inverse = (
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in (BASE, pow(int(BASE), -1, 1 << 64))
            )
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        terms = self.sums[1:]
        np.take(self.values, raw, out=terms)
        terms *= _Spans.powers[: len(raw)]
        np.cumsum(terms, out=terms)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * _Spans.inverse[starts])


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string start and end; single spaces or line ends between them."""
    gaps = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    return np.concatenate((np.zeros(1, np.int64), gaps + 1)), np.append(gaps, len(raw))


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words of all texts with a single space between any two, and how many each text has."""
    plain = [b" ".join(t.split()) for t in texts]
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in plain], np.int64)
    return b" ".join([t for t in plain if t]), counts


def _mers(spans: _Spans, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans.of(starts[: len(starts) - MER + 1], ends[MER - 1 :]) if len(starts) >= MER else np.zeros(0, np.uint64)


def _slot(mers: np.ndarray) -> np.ndarray:
    return (mers & np.uint64(SLOTS - 1)).astype(np.int64)


def _frequent(texts: DataFrame) -> bytes:
    """One byte per slot: whether the runs of words in it are many. The table has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for _, part in _chunks(batches):
            # runs that reach from one text into the next are counted too; they are as rare as texts
            joined, words = _joined(part)
            if words.any():
                raw = np.frombuffer(joined, np.uint8)
                counts += np.bincount(_slot(_mers(_Spans(raw), *_words(raw))), minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    sums = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return (counts > CROWDED * counts.mean()).astype(np.uint8).tobytes()


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Runs:
    """Super-k-mers of some texts: the text, the first window, how many windows, the minimiser and the packed words."""

    text: np.ndarray
    first: np.ndarray
    length: np.ndarray
    least: np.ndarray
    strings: list[bytes]


def runs(texts: list[bytes], size: int, crowded: np.ndarray) -> Runs:
    joined, counts = _joined(texts)
    ends = np.cumsum(counts)
    none = np.zeros(0, np.int64)
    if counts.max(initial=0) < size:
        return Runs(none, none, none, none.astype(np.uint64), [])
    raw = np.frombuffer(joined, np.uint8)
    begin, close = _words(raw)
    mers = _mers(_Spans(raw), begin, close)
    order = (mers >> np.uint64(1)) | (crowded[_slot(mers)].astype(np.uint64) << np.uint64(63))
    least = _sliding_minimum(order, size - MER + 1)
    owner = np.repeat(np.arange(len(texts)), counts)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + size <= ends[owner])  # windows within one text
    least, owner = least[inside], owner[inside]
    change = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))))
    length = np.diff(np.append(change, len(least)))
    if length.max() > RUN:
        pieces = -(-length // RUN)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        change = np.repeat(change, pieces) + within * RUN
        length = np.diff(np.append(change, len(least)))
    start = inside[change]
    strings = [joined[a:b] for a, b in zip(begin[start].tolist(), close[start + length + size - 2].tolist())]
    return Runs(owner[change], start - (ends - counts)[owner[change]], length, least[change], strings)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut into pieces of about ``CHUNK`` bytes of text."""
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK)))
            batch = whole.slice(first, last - first)
            yield batch, batch.column("text").cast(pa.binary()).to_pylist()
            first = last


def _super_kmers(texts: DataFrame, size: int, buckets: int, crowded_bytes: bytes) -> DataFrame:
    """(bucket, packed): each task's super-k-mers by bucket, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, sent = np.frombuffer(crowded_bytes, np.uint8), {}
        pack = zstandard.ZstdCompressor(level=3)
        held: dict[int, list[bytes]] = defaultdict(list)

        def flush() -> pa.RecordBatch:
            packed = [pack.compress(b"\n".join(strings)) for strings in held.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])
            held.clear()
            return out

        volume = 0
        for _, part in _chunks(batches):
            found = runs(part, size, crowded)
            for bucket, string in zip((_mixed(found.least) % np.uint64(buckets)).tolist(), found.strings):
                digest = xxhash.xxh3_128_digest(string)
                times = sent.get(digest, 0)
                if times < 2:
                    sent[digest] = times + 1
                    held[bucket].append(string)
                    volume += len(string)
            if volume > PACKED:
                yield flush()
                volume = 0
        yield flush()

    return texts.select("text").mapInArrow(run, "bucket int, packed binary")


def repeated_windows(strings: list[bytes], size: int = SIZE) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings, and per string a 64-bit mask of its windows that start twice or more in ``strings``."""
    copies = Counter(strings)
    distinct = list(copies)
    blob = b"\n".join(distinct)
    raw = np.frombuffer(blob, np.uint8)
    begin, close = _words(raw)
    lengths = np.fromiter((s.count(b" ") + 1 for s in distinct), np.int64, len(distinct))
    windows = lengths - size + 1
    owner = np.repeat(np.arange(len(distinct)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(lengths) - lengths, windows) + offset
    first, last = begin[place], close[place + size - 1]
    hashes = _Spans(raw).of(first, last)
    order = np.argsort(hashes)
    ranked = hashes[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    count = np.diff(np.append(head, len(ranked)))
    again = []
    for at, n in zip(head[count > 1].tolist(), count[count > 1].tolist()):
        same = order[at : at + n].tolist()
        texts = [blob[first[i] : last[i]] for i in same]
        if texts.count(texts[0]) == n:
            again += same
        else:  # different windows with one hash
            times = Counter(texts)
            again += [i for i, text in zip(same, texts) if times[text] > 1]
    masks = np.zeros(len(distinct), np.uint64)
    np.bitwise_or.at(masks, owner[again], np.uint64(1) << offset[again].astype(np.uint64))
    whole = ~np.uint64(0) >> (np.uint64(64) - np.minimum(windows, RUN).astype(np.uint64))
    return distinct, np.where(np.fromiter(copies.values(), np.int64, len(distinct)) > 1, whole, masks)


def _digests(strings: list[bytes]) -> tuple[pa.Array, pa.Array]:
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(raw[:, 0])), pa.array(np.ascontiguousarray(raw[:, 1]))


def _repeated(packed: DataFrame, size: int) -> DataFrame:
    """(high, low, mask) of the strings that hold a repeated window."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        strings = [s for blob in table.column("packed").to_pylist() for s in unpack.decompress(blob).split(b"\n")]
        distinct, masks = repeated_windows(strings, size)
        found = np.flatnonzero(masks)
        high, low = _digests([distinct[i] for i in found.tolist()])
        return pa.table({"high": high, "low": low, "mask": pa.array(masks[found].view(np.int64), pa.int64())})

    return packed.groupBy("bucket").applyInArrow(run, "high long, low long, mask long")


def _occurrences(texts: DataFrame, size: int, crowded_bytes: bytes, key_type: str) -> DataFrame:
    """(id, print, first, high, low): where each super-k-mer stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = np.frombuffer(crowded_bytes, np.uint8)
        for batch, part in _chunks(batches):
            found = runs(part, size, crowded)
            rows = pa.array(found.text)
            places = pa.array(found.first.astype(np.int32))
            columns = [batch.column("id").take(rows), batch.column("print").take(rows), places, *_digests(found.strings)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "print", "first", "high", "low"])

    return texts.mapInArrow(run, f"id {key_type}, print long, first int, high long, low long")


def covered(n_words: int, spots: list[dict] | None, size: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(n_words + 1, np.int64)
    if spots:
        first = np.array([s["first"] for s in spots], np.int64)
        mask = np.array([s["mask"] for s in spots], np.int64).view(np.uint64)
        row, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        starts = np.unique(first[row] + bit)
        edge[starts] += 1
        edge[starts + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def _compressed(texts: DataFrame, key_type: str) -> DataFrame:
    """(id, print, packed): the texts as the last join carries them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch, part in _chunks(batches):
            packed = pa.array([pack.compress(t) for t in part], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), packed], names=["id", "print", "packed"])

    return texts.mapInArrow(run, f"id {key_type}, print long, packed binary")


OUTPUT = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of ``df``: id, words, removed words, and the kept words joined by one space with their SHA-256."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(F.col(key).alias("id"), F.xxhash64(whole).alias("print"), whole.alias("text"))
    crowded = _frequent(texts)
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = cut_lineage(_repeated(_super_kmers(texts, size, buckets, crowded), size))
    spots = (
        _occurrences(texts, size, crowded, kind)
        .join(masks, ["high", "low"])
        .groupBy("id", "print")
        .agg(F.collect_set(F.struct("first", "mask")).alias("spots"))
        .select(F.col("id").alias("of"), F.col("print").alias("of_print"), "spots")
    )
    joined = _compressed(texts, kind).join(spots, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left").select("id", "packed", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column("packed")):
                words = unpack.decompress(value.as_py()).split()
                spots = batch.column("spots")[i].as_py()
                if spots:
                    gone = covered(len(words), spots, size)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
                else:
                    kept = b" ".join(words)
                    rows.append((len(words), 0, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) or [[], [], [], []]
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            arrays.append(pa.array(columns[3], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=[key, *(p.split()[0] for p in OUTPUT.split(", "))])

    return joined.mapInArrow(run, f"`{key}` {kind}, {OUTPUT}")
