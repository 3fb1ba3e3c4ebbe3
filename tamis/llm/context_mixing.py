"""LM scoring by logistic context mixing.

A text is a sequence of words and one end. Every token is coded by mixers of bit predictors: words met in training by
one, other words after an escape by another.

* A dictionary word has a code of 12 bits, from its hash. Each bit is predicted by what is known of the node it decides
  from: the counts of the dictionary, the counts under a gate (the class of the short words that lead in the text so
  far), and hashed contexts of the word before and of the two words before. The context counts come from all training
  tokens and stand in one table of fixed size, in which a context's nodes of one nibble are neighbours. The predictions
  are combined in the logistic domain by weights that are chosen by how often both contexts were seen, and learnt online
  while the text is read: after every ``CHUNK`` tokens, from these alone. Among words of one code the dictionary's counts
  decide. The escape has the share of words seen once.
* A word outside the dictionary is coded byte by byte with a closing byte, a byte by the binary decisions of a Huffman
  tree. Each decision is predicted in several hashed contexts (the last 2, 3, 4 bytes of the word, and all of it so far)
  by the counts of both outcomes in one table of fixed size. The predictions are combined in the logistic domain by
  weights, gated by how often the longest context was seen. The counts hold every distinct training word once, as new
  words resemble rare ones. The weights are learnt online, batch after batch in parts whose number and order follow from
  the words alone, with each word taken out of its own counts, and averaged over the parts.
* While a text is scored, a cache of its own words refines the prediction adaptively: several strengths of the cache run
  side by side and are weighted by how well they have predicted so far, which is their average likelihood.

All parts are distributions (the byte mixer's mass on dictionary words and the word mixer's on codes without a word are
left unused), so scores are log probabilities.

Work on Spark: one pass cuts texts into blocks of word numbers with a list of distinct words each, and counts contexts.
Words are counted over all training texts after summing per block, learnt from and scored once per distinct word, and
sent back to the blocks that hold them. No text is shuffled and no word is hot: a block brings each word once. The tables
that reach the driver have a fixed size (``SLOTS`` counts of either mixer, the weights, 256 byte counts, the gates).

Defined cases: a null text is an empty one and scores its end alone; without training texts all counts are zero and
every word is an escape; repeated rows and ids are scored each on its own; a null id counts as empty text when rows
are held out; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import stored

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
SLICES = 64
ORDERS = (2, 3, 4)  # bytes of a context; the last context is the whole word so far
CONTEXTS = len(ORDERS) + 1
LEVELS = 12  # of how often the longest context was seen
PRIOR = 0.4  # added to the counts of both outcomes
RATE = 0.08
SHORT = 3  # bytes of the words that open gates
CLASSES = 8  # of short words
GATES = CLASSES + 1  # the last: no short word so far
CODE_BITS = 12
CODES = 1 << CODE_BITS
NIBBLES = CODE_BITS // 4
LINE_BITS = SLOT_BITS - 4  # the 15 nodes of a nibble stand in one line of 16 slots
INPUTS = 4  # the dictionary, the gate, one word before, two words before
NEAR, FAR = 3, 3  # steps of how often the contexts of one and of two words were seen
SETS = NEAR * FAR
CHUNK = 64  # tokens of a text after which its weights move
STEP = 0.3
TOGETHER = 1 << 17  # tokens of texts scored side by side, about
CACHES = (0.0, 0.02, 0.08, 0.25)  # strengths of a text's own words
WORDS = 4096  # words learnt from or scored together
BLOCK_TEXT = 48 << 20  # bytes of text in a block, about
BLOCK_WORDS = 1_500_000  # distinct words in a block, about
PART = 400_000  # words for one learning task
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """Binary decisions per byte: how many, and for each the inner node and the outcome."""

    sizes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        left, right = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, left), (1, right)):
            for byte in side[2]:
                paths[byte].append((node, bit))
        heapq.heappush(heap, (left[0] + right[0], 256 + node, left[2] + right[2]))
    sizes = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((256, sizes.max()), np.int64), np.zeros((256, sizes.max()), np.int64)
    for byte, path in enumerate(paths):
        for k, (node, bit) in enumerate(reversed(path)):
            nodes[byte, k], bits[byte, k] = node, bit
    return Tree(sizes, nodes, bits)


def decisions(words: list[bytes], tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, outcome, slots) of all decisions that code the words; slots: one column per context."""
    raw = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.int64)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    within = np.arange(len(raw)) - starts[owner]
    shifted = raw.astype(np.uint64) + np.uint64(1)
    context = np.zeros(len(raw), np.uint64)
    contexts = []
    for order in range(1, max(ORDERS) + 1):
        back = np.zeros(len(raw), np.uint64)
        back[order:] = shifted[:-order]
        back[within < order] = 0
        context = context * np.uint64(257) + back
        if order in ORDERS:
            contexts.append(context + np.uint64(order << 56))
    powers = np.full(len(raw), MIX, np.uint64)
    powers[0] = 1
    inverse = np.full(len(raw), np.uint64(pow(int(MIX), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shifted * np.cumprod(powers))))
    first = starts[owner]
    contexts.append((sums[:-1] - sums[first]) * np.cumprod(inverse)[first] + np.uint64(1 << 62))
    sizes = tree.sizes[raw]
    at = np.repeat(np.arange(len(raw)), sizes)
    step = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    node = (tree.nodes[raw[at], step].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    slots = np.empty((CONTEXTS, len(at)), np.int64)
    for order, context in enumerate(contexts):
        context = (context ^ (context >> np.uint64(29))) * MIX
        mixed = (context[at] ^ node) * np.uint64(0xBF58476D1CE4E5B9)
        slots[order] = ((mixed ^ (mixed >> np.uint64(32))) * MIX) >> np.uint64(64 - SLOT_BITS)
    return owner[at], tree.bits[raw[at], step], slots


def level(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(seen + 1), LEVELS - 1).astype(np.int64)


def stretch(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + PRIOR) / (zero + PRIOR))


def mixed(stretched: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The combined prediction of each decision in the logistic domain."""
    return sum(weights[:, context][at] * stretched[context] for context in range(CONTEXTS))


class Model:
    """The mixer as it stands after learning."""

    def __init__(self, tree: Tree, counts: np.ndarray, weights: np.ndarray):
        self.tree, self.weights = tree, weights
        self.stretched, self.levels = stretch(counts[:, 0], counts[:, 1]), level(counts.sum(axis=1)).astype(np.int8)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word."""
        owner, bit, slots = decisions(words, self.tree)
        total = mixed(self.stretched[slots], self.weights, self.levels[slots[-1]])
        return np.bincount(owner, -np.logaddexp(0, np.where(bit == 1, -total, total)), len(words))


def initial_weights() -> np.ndarray:
    return np.full((LEVELS, CONTEXTS), 1.0 / CONTEXTS)


class Learner:
    """Learns mixing weights online. Every word is predicted from counts without itself."""

    def __init__(self, tree: Tree, counts: np.ndarray):
        self.tree, self.counts = tree, counts
        self.weights, self.squares = initial_weights(), np.full((LEVELS, CONTEXTS), 1e-6)

    def learn(self, words: list[bytes]) -> None:
        _, bit, slots = decisions(words, self.tree)
        zero, one = self.counts[slots, 0], self.counts[slots, 1]
        zero -= bit == 0
        one -= bit == 1
        stretched = stretch(zero, one)
        at = level(zero[-1] + one[-1])
        error = bit - 1 / (1 + np.exp(-np.clip(mixed(stretched, self.weights, at), -30, 30)))
        seen = np.maximum(np.bincount(at, minlength=LEVELS), 1)
        for context in range(CONTEXTS):
            slope = np.bincount(at, error * stretched[context], LEVELS) / seen
            self.squares[:, context] += slope**2
            self.weights[:, context] += RATE * slope / np.sqrt(self.squares[:, context])


def training(key: Column, remainder: int = 1) -> Column:
    """Whether a row's text is learnt from: crc32 of the id as text, modulo 5, is another."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != remainder


def class_of(word: bytes) -> int:
    """The class of a short word; -1: the word opens no gate."""
    return xxhash.xxh32_intdigest(word) % CLASSES if len(word) <= SHORT and word != b"\n" else -1


def mark_of(word: bytes) -> int:
    """28 bits of a word's hash, the code first, then its class in 4 bits."""
    return xxhash.xxh64_intdigest(word) >> 36 << 4 | class_of(word) + 1


def code_of(marks: np.ndarray) -> np.ndarray:
    return (marks >> 20).astype(np.int64)


def gates_of(classes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The gate before each token: the class that leads among the text's tokens so far, the lowest of equals."""
    opening = classes >= 0
    at, counted = np.flatnonzero(opening), np.cumsum(opening) - opening
    if not len(at):
        return np.full(len(classes), CLASSES)
    of = owner[at]
    counts = np.zeros((len(at) + 1, CLASSES), np.int32)
    np.cumsum(classes[at, None] == np.arange(CLASSES), axis=0, out=counts[1:])
    leading = (counts[1:] - counts[np.searchsorted(of, np.arange(texts))][of]).argmax(axis=1)
    last = np.maximum(counted - 1, 0)
    return np.where((counted > 0) & (of[last] == owner), leading[last], CLASSES)


@dataclass
class Run:
    """Texts one after the other: per token its text, its place there, its mark, its gate and the keys of its contexts."""

    owner: np.ndarray
    place: np.ndarray
    marks: np.ndarray
    gates: np.ndarray
    keys: np.ndarray  # one row per context


def run_of(marks: np.ndarray, sizes: np.ndarray) -> Run:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(marks)) - starts[owner]
    gates = gates_of((marks & 15).astype(np.int64) - 1, owner, len(sizes))
    wide = marks.astype(np.uint64) + np.uint64(1)
    back = np.zeros((2, len(marks)), np.uint64)  # zero: no such word
    for order in (1, 2):
        back[order - 1, order:] = wide[:-order]
        back[order - 1, place < order] = 0
    keys = np.stack([back[0] * MIX + np.uint64(1), (back[0] + back[1] * np.uint64(0xD6E8FEB86659FD93)) * MIX + np.uint64(2)])
    return Run(owner, place, marks, gates, keys ^ (keys >> np.uint64(29)))


# by value, the inner nodes on the way to a nibble; by code, the outcomes of its bits and the nodes they decide from
NODES = np.array([[(1 << k) | v >> 4 - k for v in range(16)] for k in range(4)], np.int64)
BITS = np.array([[v >> CODE_BITS - 1 - k & 1 for v in range(CODES)] for k in range(CODE_BITS)], np.int64)
PATHS = np.array([[(1 << k) | v >> CODE_BITS - k for v in range(CODES)] for k in range(CODE_BITS)], np.int64)
SIGNS = (1 - 2 * BITS).astype(np.float32)


def code_slots(keys: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Slots of each token's nodes in each context: (context, bit, token)."""
    slots = np.empty((len(keys), NIBBLES, 4, len(code)), np.int64)
    for k in range(NIBBLES):
        rest = code >> CODE_BITS - 4 * k - 4
        line = ((1 << 4 * k) | rest >> 4).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        within = np.take(NODES, rest & 15, axis=1, mode="clip")
        for order, key in enumerate(keys):
            hashed = (key ^ line) * np.uint64(0xBF58476D1CE4E5B9)
            at = ((hashed ^ (hashed >> np.uint64(32))) * MIX >> np.uint64(64 - LINE_BITS)).view(np.int64) << 4
            np.add(at, within, out=slots[order, k])
    return slots.reshape(len(keys), CODE_BITS, len(code))


class Contexts:
    """Counts of training tokens: of both outcomes of each node in its contexts, and of each code under each gate."""

    def __init__(self):
        self.table, self.gated = np.zeros(2 * SLOTS, np.int32), np.zeros(GATES * CODES, np.int32)

    def add(self, marks: np.ndarray, sizes: np.ndarray) -> None:
        run = run_of(marks, sizes)
        code = code_of(marks)
        np.add.at(self.gated, run.gates * CODES + code, np.int32(1))
        for at in range(0, len(code), WORDS):
            part = code[at : at + WORDS]
            cells = code_slots(run.keys[:, at : at + WORDS], part)
            cells <<= 1
            cells += np.take(BITS, part, axis=1, mode="clip")
            np.add.at(self.table, cells.ravel(), np.int32(1))

    def slices(self) -> list[tuple[int, bytes]]:
        """(negative number, packed counts) of all parts of the tables that are not empty."""
        parts = [*self.table.reshape(SLICES, -1), self.gated]
        return [(-1 - i, _squeezed(part)) for i, part in enumerate(parts) if part.any()]


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts as planes of bytes, of which the high ones hold nearly nothing."""
    planes = counts.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _released(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _packed(ids: np.ndarray) -> bytes:
    """Numbers in 3 bytes each, or 4 where one needs them; the last byte tells which."""
    if len(ids) and ids.max() >= 1 << 24:
        return ids.astype("<u4").tobytes() + b"\x04"
    return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype(np.uint8).tobytes() + b"\x03"


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // raw[-1]
    if raw[-1] == 4:
        return np.frombuffer(raw, "<u4", n).astype(np.int64)
    return np.frombuffer(raw, "<u2", n).astype(np.int64) | np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int64) << 16


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Document rows (block, id, training, bytes, tokens), word rows (block, number, word, times in training texts) and, once
    a task, rows of context counts (task, negative number, counts)."""
    schema = f"block long, id {kind}, training boolean, bytes long, tokens binary, number int, word binary, times int"
    names = [part.split()[0] for part in schema.split(", ")]

    def batch_of(columns: dict[str, pa.Array], like: pa.DataType) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        types = {"block": pa.int64(), "id": like, "training": pa.bool_(), "bytes": pa.int64(), "tokens": pa.binary(), "number": pa.int32(),
                 "word": pa.binary(), "times": pa.int32()}
        return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(size, types[n]) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        numbers, volume, like = _Numbers(), 0, pa.null()
        times, marks = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        contexts = Contexts()

        def words() -> Iterator[pa.RecordBatch]:
            listed = list(numbers)
            for at in range(0, len(listed), 1 << 16):
                part = slice(at, min(at + (1 << 16), len(listed)))
                columns = {
                    "block": pa.array(np.full(part.stop - at, block)),
                    "number": pa.array(np.arange(at, part.stop, dtype=np.int32)),
                    "word": pa.array(listed[part], pa.binary()),
                    "times": pa.array(times[part]),
                }
                yield batch_of(columns, like)

        for whole in batches:
            done = 0
            while done < whole.num_rows:
                batch, full = whole.slice(done, 128), False
                like = batch.column("id").type
                tokens, sizes, known = [], [], len(numbers)
                learn = batch.column("training").to_pylist()
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    cut = text.lower().split()
                    cut.append(b"\n")  # the end; no word holds this byte
                    tokens.append(np.fromiter(map(numbers.__getitem__, cut), np.int64, len(cut)))
                    sizes.append(len(text))
                    volume += len(text)
                    full = volume > BLOCK_TEXT or len(numbers) > BLOCK_WORDS
                    if full:
                        break
                batch = batch.slice(0, len(tokens))
                done += len(tokens)
                marks = np.concatenate([marks, np.fromiter(map(mark_of, islice(numbers, known, None)), np.uint32)])
                if len(numbers) > len(times):
                    times = np.concatenate([times, np.zeros(len(numbers), np.int32)])
                learnt = [ids for ids, use in zip(tokens, learn) if use]
                if learnt:
                    ids = np.concatenate(learnt)
                    np.add.at(times, ids, np.int32(1))
                    contexts.add(marks[ids], np.fromiter(map(len, learnt), np.int64, len(learnt)))
                yield batch_of(
                    {
                        "block": pa.array(np.full(batch.num_rows, block)),
                        "id": batch.column("id"),
                        "training": batch.column("training"),
                        "bytes": pa.array(sizes, pa.int64()),
                        "tokens": pa.array(list(map(_packed, tokens)), pa.binary()),
                    },
                    like,
                )
                if full:
                    yield from words()
                    block, volume = block + 1, 0
                    numbers.clear()
                    times, marks = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        if numbers:
            yield from words()
        task = TaskContext.get().partitionId()
        for number, counts in contexts.slices():
            yield batch_of({"block": pa.array([task]), "number": pa.array([number], pa.int32()), "word": pa.array([counts], pa.binary())}, like)

    return rows.mapInArrow(run, schema)


def _coded(word: bytes) -> bytes:
    return b"" if word == b"\n" else word


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    for whole in batches:
        for at in range(0, whole.num_rows, WORDS):
            batch = whole.slice(at, WORDS)
            if batch.num_rows:
                yield [_coded(w) for w in batch.column("word").to_pylist()], batch


def _byte_counts(counts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for words, batch in _chunks(batches):
            raw = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
            total += np.bincount(raw, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for row in counts.mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[row["byte"]] = row["n"]
    return out


def _merged(slices: DataFrame, sizes: list[int]) -> np.ndarray:
    """The sums of (number, salt, counts) by number, in two steps, one after the other; ``sizes`` are bounded and few."""

    def merge(rows: pa.Table) -> pa.Table:
        total = sum(_released(blob.as_py()) for blob in rows.column("counts"))
        first = rows.slice(0, 1)
        return pa.table({"number": first.column("number"), "salt": first.column("salt"), "counts": pa.array([_squeezed(total)], pa.binary())})

    schema = "number int, salt int, counts binary"
    merged = slices.groupBy("number", "salt").applyInArrow(merge, schema).groupBy("number").applyInArrow(merge, schema)
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1], np.float32)
    for row in merged.collect():  # one row a size, whatever the input
        out[ends[row["number"]] - sizes[row["number"]] : ends[row["number"]]] = _released(bytes(row["counts"]))
    return out


def _slot_counts(counts: DataFrame, tree: Tree) -> np.ndarray:
    """Counts of both outcomes in all slots: summed in each task, merged by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * SLOTS, np.int64)
        for words, batch in _chunks(batches):
            _, bit, slots = decisions(words, tree)
            for column in slots:
                np.add.at(table, 2 * column + bit, 1)
        salt = TaskContext.get().partitionId() % 16
        for number, part in enumerate(table.reshape(SLICES, -1)):
            if part.any():
                columns = [pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([_squeezed(part)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "salt", "counts"])

    return _merged(counts.mapInArrow(run, "number int, salt int, counts binary"), [2 * SLOTS // SLICES] * SLICES).reshape(SLOTS, 2)


def _mixing_weights(learnt: DataFrame, parts: int, tree: Tree, table) -> np.ndarray:
    """Weights learnt online in each part, averaged by the words they were learnt from.

    A word's hash gives its part and its place there, so the layout of the input changes nothing.
    """
    turn = F.xxhash64("word")
    fixed = learnt.select("word").repartition(parts, turn).sortWithinPartitions(turn, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Learner(tree, table.value), 0
        for words, batch in _chunks(batches):
            learner.learn(words)
            seen += batch.num_rows
        flat = learner.weights.ravel()
        columns = [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "total", "seen"])

    out = initial_weights().ravel()
    rows = fixed.mapInArrow(run, "place int, total double, seen double").groupBy("place").agg(F.sum("total").alias("t"), F.sum("seen").alias("s"))
    for row in rows.collect():
        if row["s"]:
            out[row["place"]] = row["t"] / row["s"]
    return out.reshape(LEVELS, CONTEXTS)


def starting_weights() -> np.ndarray:
    """(input, set): the more often a longer context was seen, the less weight have the shorter ones."""
    near, far = np.divmod(np.arange(SETS), FAR)
    two, one = far / (far + 1.5), near / (near + 0.4)
    rest = (1 - two) * (1 - one)
    return np.stack([0.2 * rest, 0.8 * rest, (1 - two) * one, two]).astype(np.float32)


class Mixer:
    """Predictors of the codes of dictionary words."""

    def __init__(self, table: np.ndarray, gated: np.ndarray):
        self.context = stretch(table[:, 0], table[:, 1]).astype(np.float32)
        # the first slot of a line is no node; it tells how often the line's first node was seen
        self.context[::16] = np.log2(table[1::16].sum(axis=1) + 1)
        codes = gated.reshape(GATES, CODES).astype(np.float64)
        self.codes = codes.sum(axis=0)
        smoothed = codes + 200.0 * self.codes / max(self.codes.sum(), 1)  # by all texts
        # by bit, and by gate and code: what is known of the nodes on the way to a code
        self.gate = np.ascontiguousarray(self._nodes(smoothed)[:, PATHS].transpose(1, 0, 2).reshape(CODE_BITS, -1))
        self.plain = self._nodes(self.codes[None])[0, PATHS]

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Mixer:
        """From the arrays of another: a broadcast holds these, as its readers need not find this class."""
        out = cls.__new__(cls)
        vars(out).update(arrays)
        return out

    @staticmethod
    def _nodes(codes: np.ndarray) -> np.ndarray:
        """What the counts of the codes predict at each node of the code, heap order."""
        out = np.zeros((len(codes), CODES), np.float32)
        for k in range(CODE_BITS):
            sides = codes.reshape(len(codes), 1 << k, 2, -1).sum(axis=3)
            out[:, 1 << k : 2 << k] = np.log((sides[:, :, 1] + 1e-2) / (sides[:, :, 0] + 1e-2))
        return out

    def log_probabilities(self, run: Run, texts: int, known: np.ndarray) -> np.ndarray:
        """Natural logs of the codes of all tokens, 0 for those not ``known``; weights are learnt text by text."""
        weights = np.tile(starting_weights(), (1, texts))
        squares = np.ones(weights.shape, np.float32)
        out = np.zeros(len(run.marks))
        use = np.flatnonzero(known)
        turn = run.place[use] // CHUNK
        order = np.argsort(turn, kind="stable")
        use, ends = use[order], np.cumsum(np.bincount(turn)) if len(use) else []
        for start, end in zip([0, *ends], ends):
            for part in ([use[start:end]] if end > start else []):
                code, owner = code_of(run.marks[part]), run.owner[part]
                slots = code_slots(run.keys[:, part], code)
                inputs = [
                    np.take(self.plain, code, axis=1, mode="clip"),
                    np.take(self.gate, run.gates[part] * CODES + code, axis=1, mode="clip"),
                    np.take(self.context, slots[0], mode="clip"),
                    np.take(self.context, slots[1], mode="clip"),
                ]
                inputs = [x.reshape(NIBBLES, 4, -1) for x in inputs]
                # a nibble's bits share the weights that its first node chooses
                near, far = (np.take(self.context, s[::4] - 1, mode="clip") for s in slots)
                at = owner * SETS + np.minimum(near / 2, NEAR - 1).astype(np.int64) * FAR + np.minimum(far, FAR - 1).astype(np.int64)
                # in place, as most of the time goes here; ``likely`` is the probability of the bit that came
                total = np.take(weights[0], at, mode="clip")[:, None] * inputs[0]
                for w, x in zip(weights[1:], inputs[1:]):
                    total += np.take(w, at, mode="clip")[:, None] * x
                sign = np.take(SIGNS, code, axis=1, mode="clip").reshape(total.shape)
                total *= sign
                np.exp(np.clip(total, -30, 30, out=total), out=total)
                total += 1
                likely = np.divide(1, total, out=total)
                out[part] = np.log(np.multiply.reduce(likely.reshape(CODE_BITS, -1), axis=0, dtype=np.float64))
                error, first = np.subtract(likely, 1, out=likely), owner[0] * SETS
                error *= sign
                flat, size = (at - first).ravel(), (owner[-1] + 1) * SETS - first
                reached = slice(first, first + size)
                for w, q, x in zip(weights, squares, inputs):
                    x *= error
                    slope = np.bincount(flat, x.sum(axis=1).ravel(), size).astype(np.float32)
                    q[reached] += slope**2
                    w[reached] += STEP * slope / np.sqrt(q[reached])
        return out


@dataclass
class Dictionary:
    """What a block knows of its words, by number: their marks, occurrences in training, and the byte mixer's log of new words."""

    marks: np.ndarray
    times: np.ndarray
    spelled: np.ndarray
    escape: float

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray, run: Run, mixer: Mixer) -> np.ndarray:
        """Natural logs of all tokens of texts that stand one after the other."""
        times = self.times[ids]
        coded = mixer.log_probabilities(run, len(sizes), times > 0)
        stay = math.log1p(-self.escape) if self.escape < 1 else 0.0
        among = np.log(np.maximum(times, 1) / np.maximum(mixer.codes[code_of(run.marks)], 1))
        return np.where(times > 0, stay + coded + among, math.log(self.escape) + self.spelled[ids])


def text_scores(texts: list[np.ndarray], dictionary: Dictionary, mixer: Mixer) -> np.ndarray:
    """Natural log probabilities of texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.concatenate(texts)
    run = run_of(dictionary.marks[ids], sizes)
    base = dictionary.log_probabilities(ids, sizes, run, mixer)
    named = run.owner * (ids.max() + 1) + ids
    order = np.argsort(named, kind="stable")
    ranked = named[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    earlier = np.empty(len(ids), np.int64)
    earlier[order] = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
    share = earlier / np.maximum(run.place, 1)
    again, started = np.flatnonzero(earlier), run.place > 0
    likely, share = np.exp(base[again]), share[again]
    totals = []
    for cache in CACHES:
        new = base
        if cache:
            new = base + math.log1p(-cache) * started
            new[again] = np.log((1 - cache) * likely + cache * share + 1e-300)
        totals.append(np.bincount(run.owner, new, len(texts)))
    return np.logaddexp.reduce(totals) - math.log(len(totals))


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", remainder: int = 1) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of ``df``."""
    kind = df.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    packed = stored(_blocks(df.select(F.col(key).alias("id"), whole.alias("text"), training(F.col(key), remainder).alias("training")), kind))
    documents = packed.where("word IS NULL").select("block", "id", "training", "bytes", "tokens")
    words = packed.where("word IS NOT NULL AND number >= 0").select("block", "number", "word", "times")
    slices = packed.where("number < 0").select((-1 - F.col("number")).alias("number"), (F.col("block") % 16).cast("int").alias("salt"), F.col("word").alias("counts"))
    contexts = _merged(slices, [2 * SLOTS // SLICES] * SLICES + [GATES * CODES])
    counts = stored(words.groupBy("word").agg(F.sum("times").alias("times")))
    figures = counts.agg(
        F.count(F.when(F.col("times") > 0, 1)).alias("v"),
        F.count(F.when(F.col("times") == 1, 1)).alias("once"),
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"),
    ).first()
    n, v = figures["n"], figures["v"]
    escape = (figures["once"] + 1) / (n + 2) if n else 1.0
    parts = max(1, math.ceil(v / PART))
    learnt = counts.where("times > 0").select("word").coalesce(parts)
    tree = huffman(_byte_counts(learnt))
    table = df.sparkSession.sparkContext.broadcast(_slot_counts(learnt, tree))
    weights = _mixing_weights(learnt, parts, tree, table)
    # made once, not for every block
    met = df.sparkSession.sparkContext.broadcast(vars(Mixer(contexts[: 2 * SLOTS].reshape(SLOTS, 2), contexts[2 * SLOTS :])))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(tree, table.value, weights)
        for cut, batch in _chunks(batches):
            logs = np.zeros(len(cut))
            fresh = np.flatnonzero(batch.column("times").to_numpy() == 0)
            if len(fresh):
                logs[fresh] = model.log_probabilities([cut[i] for i in fresh])
            marks = np.fromiter(map(mark_of, batch.column("word").to_pylist()), np.uint32, len(cut)).view(np.int32)
            columns = [*batch.columns, pa.array(marks), pa.array(logs.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "mark", "spelled"])

    spelled = counts.mapInArrow(spell, "word binary, times long, mark int, spelled float")
    # what a block gets back of its words is numbers alone
    known = words.select(F.col("block").alias("of_block"), "number", "word").join(spelled, "word").drop("word")
    schema = f"id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def score(docs: pa.Table, listed: pa.Table) -> pa.Table:
        number = listed.column("number").to_numpy()
        order = np.argsort(number)

        def column(name: str) -> np.ndarray:
            return listed.column(name).to_numpy()[order]

        dictionary = Dictionary(column("mark").view(np.uint32), column("times"), column("spelled").astype(np.float64), escape)
        mixer = Mixer.of(met.value)
        base = np.log10((dictionary.times + 0.5) / (n + 0.5 * (v + 1)))
        texts, rows = list(map(_unpacked, docs.column("tokens").to_pylist())), []
        groups = np.cumsum([0, *map(len, texts)])[:-1] // TOGETHER
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(groups)) + 1):
            group = texts[at[0] : at[-1] + 1]
            for ids, log, size in zip(group, text_scores(group, dictionary, mixer), docs.column("bytes")[at[0] : at[-1] + 1].to_pylist()):
                log10 = float(log) / math.log(10)
                rows.append((len(ids), int((dictionary.times[ids] > 0).sum()), n, float(base[ids].sum()), log10, -log10 * math.log2(10) / max(size, 1)))
        out = {"id": docs.column("id"), "training": docs.column("training")}
        names = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
        for name, values in zip(names, zip(*rows) if rows else [[]] * len(names)):
            out[name] = pa.array(values, pa.int64() if name.startswith(("n_", "train")) else pa.float64())
        return pa.table(out)

    return documents.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(score, schema).withColumnRenamed("id", key)
