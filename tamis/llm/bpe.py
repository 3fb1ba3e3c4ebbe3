"""Byte-level BPE by merge replay over a corpus of words, and decoding.

``encode`` cuts each text into matches of the pattern. A task gathers the distinct matches of its blocks of
documents that it has not met before and replays the merges over all of them at once: an inverted index
leads from a merge's rank to the positions where it applies, ranks are taken in order from a heap, and a
merge updates only the pairs with its left and right neighbour. A match met again costs one lookup.

Merging rank by rank over all words gives what merging word by word gives, as words do not touch, unless a
merge makes a pair of a lower rank than its own; a word where that happens is replayed by itself, from a heap
of its own pairs.

Work is row-local: no shuffle, any copies or hot sources are spread as the input is. Memory is bounded by a
block of documents and by ``REMEMBERED`` matches; after that many, the memory starts anew.

Defined cases: a null text is an empty one with no ids; special tokens are ordinary text; a null list of
ids decodes to nothing; repeated rows and ids are encoded each on its own; an empty table gives an empty
result; of other columns, only those named in ``keep`` are read.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 300_000
PAIRS = 200_000  # pairs whose merge is remembered
BLOCK = 6 << 20  # bytes of text encoded together
PASSED = 64  # documents in a batch that is passed on


def read_ranks(path: str) -> bytes:
    """The rank file, to be read where it lies: on the driver. Its size does not depend on the documents."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Ranks of byte strings, which are their ids."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_ranks: dict[int, int] = {}  # left id << 32 | right id -> rank of their merge, -1: none
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)

    def pair_rank(self, pair: int) -> int:
        rank = self.pair_ranks.get(pair)
        if rank is None:
            if len(self.pair_ranks) >= PAIRS:
                self.pair_ranks.clear()
            rank = self.pair_ranks[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return rank

    def encode_word(self, word: bytes) -> list[int]:
        """One word by itself: the lowest rank first, the leftmost of equals.

        Pairs wait in a heap by rank and position, symbols are linked to their neighbours, and a merge looks at two
        pairs only, so time grows with n log n.
        """
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        end, pair_rank = len(symbols), self.pair_rank
        follow, before = list(range(1, end + 1)), list(range(-1, end - 1))
        ranks = [pair_rank(a << 32 | b) for a, b in zip(symbols, symbols[1:])]
        heap = [rank << 40 | at for at, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank, at = divmod(heapq.heappop(heap), 1 << 40)
            right = follow[at]
            if symbols[at] < 0 or right == end or pair_rank(symbols[at] << 32 | symbols[right]) != rank:
                continue  # one of the two was merged meanwhile
            after, left = follow[right], before[at]
            symbols[at], symbols[right], follow[at] = rank, -1, after
            if after < end:
                before[after] = at
                new = pair_rank(rank << 32 | symbols[after])
                if new >= 0:
                    heapq.heappush(heap, new << 40 | at)
            if left >= 0:
                new = pair_rank(symbols[left] << 32 | rank)
                if new >= 0:
                    heapq.heappush(heap, new << 40 | left)
        return [s for s in symbols if s >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has.

        Every merge in rank order over an inverted index from pair to positions.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.byte_ids[raw]
        follow, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        used = sizes > 0
        follow[starts[used] + sizes[used] - 1] = -1
        before[starts[used]] = -1
        work = _Replay(self, symbols, follow, before)
        joined = np.flatnonzero(follow >= 0)
        work.note(symbols[joined] << 32 | symbols[joined + 1], joined, -1)
        work.run()
        left = symbols >= 0
        ids, counts = symbols[left], np.bincount(np.repeat(np.arange(len(words)), sizes)[left], minlength=len(words))
        alone = np.unique(np.searchsorted(starts, sorted(work.alone), side="right") - 1)
        if len(alone):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for number in alone.tolist():
                parts[number] = np.array(self.encode_word(words[number]), np.int64)
                counts[number] = len(parts[number])
            ids = np.concatenate(parts)
        return ids.astype(np.int32), counts

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.data[place].tobytes()


class _Replay:
    """The state of one replay: symbols of all words in a row, each linked to its neighbours within its word."""

    FEW = 24  # positions that are merged one by one

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray, follow: np.ndarray, before: np.ndarray):
        self.vocabulary, self.symbols, self.follow, self.before = vocabulary, symbols, follow, before
        self.index: dict[int, list[int]] = {}  # pair -> positions of its left symbol
        self.heap: list[tuple[int, int]] = []  # (rank, pair) of the pairs in the index
        self.alone: set[int] = set()  # positions in words where a merge made a pair of a lower rank

    def _add(self, pair: int, rank: int, places: list[int], least: int) -> None:
        if rank < least:
            self.alone.update(places)
        if pair in self.index:
            self.index[pair] += places
        else:
            self.index[pair] = places
            heapq.heappush(self.heap, (rank, pair))

    def note(self, pairs: np.ndarray, places: np.ndarray, least: int) -> None:
        """Put pairs and their positions into the index. ``least``: the rank just merged."""
        order = np.argsort(pairs, kind="stable")
        pairs, places = pairs[order], places[order].tolist()
        edges = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1], [True]))).tolist() if len(pairs) else [0]
        for first, last in zip(edges, edges[1:]):
            pair = int(pairs[first])
            rank = self.vocabulary.pair_rank(pair)
            if rank >= 0:
                self._add(pair, rank, places[first:last], least)

    def run(self) -> None:
        while self.heap:
            rank, pair = heapq.heappop(self.heap)
            same = [pair]
            while self.heap and self.heap[0][0] == rank:
                same.append(heapq.heappop(self.heap)[1])
            places = sorted(p for s in same for p in self.index.pop(s))
            if len(same) == 1 and len(places) > self.FEW and pair >> 32 != pair & 0xFFFFFFFF:
                self._together(rank, pair, np.array(places))
            else:
                self._singly(rank, set(same), places)

    def _singly(self, rank: int, pairs: set[int], places: list[int]) -> None:
        symbols, follow, before = memoryview(self.symbols), memoryview(self.follow), memoryview(self.before)
        pair_rank = self.vocabulary.pair_rank
        for at in places:
            right = follow[at]
            if right < 0 or symbols[at] < 0 or symbols[at] << 32 | symbols[right] not in pairs:
                continue  # a neighbour was merged meanwhile
            after, left = follow[right], before[at]
            symbols[at], symbols[right], follow[at] = rank, -1, after
            if after >= 0:
                before[after] = at
                pair = rank << 32 | symbols[after]
                new = pair_rank(pair)
                if new >= 0:
                    self._add(pair, new, [at], rank)
            if left >= 0:
                pair = symbols[left] << 32 | rank
                new = pair_rank(pair)
                if new >= 0:
                    self._add(pair, new, [left], rank)

    def _together(self, rank: int, pair: int, places: np.ndarray) -> None:
        """All positions of one pair of different symbols, which cannot overlap."""
        symbols, follow, before = self.symbols, self.follow, self.before
        places = places[np.concatenate(([True], places[1:] != places[:-1]))]
        right = follow[places]
        valid = (right >= 0) & (symbols[places] == pair >> 32) & (symbols[right] == pair & 0xFFFFFFFF)
        places, right = places[valid], right[valid]
        after = follow[right]
        symbols[places], symbols[right], follow[places] = rank, -1, after
        ends = after >= 0
        before[after[ends]] = places[ends]
        low = self.vocabulary.pair_rank(rank << 32 | pair >> 32)
        if 0 <= low < rank:  # one by one, the next left symbol would have been met before its own merge
            self.alone.update(places.tolist())
        left = before[places]
        inner = left >= 0
        here, twice = left[inner], symbols[left[inner]] != rank  # a merged left neighbour notes the pair itself
        self.note(
            np.concatenate((rank << 32 | symbols[after[ends]], symbols[here[twice]] << 32 | rank)),
            np.concatenate((places[ends], here[twice])),
            rank,
        )


@lru_cache(maxsize=1)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


class Encoder:
    """Encodes blocks of texts and remembers the matches it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.matches, self.remembered = vocabulary, regex.compile(pattern).findall, remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.numbers) > self.remembered:
            self._forget()
        known, number_of = len(self.numbers), self.numbers.__getitem__
        numbered = [np.fromiter(map(number_of, self.matches(t)), np.int32) for t in texts]
        if len(self.numbers) > known:
            ids, sizes = self.vocabulary.replay([w.encode() for w in islice(self.numbers, known, None)])
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        for number in numbered:
            size = self.sizes[number]
            ends = np.cumsum(size)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[number] - (ends - size), size) if len(number) else number
            yield self.flat[place]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK)))
        yield first, last
        first = last


def encode(
    df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "ids", decoded: str | None = None
) -> DataFrame:
    """The kept columns and ``ids`` (array of int) of every row; with ``decoded``, also what the ids decode to, in one pass."""
    columns = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` array<int>"]
    schema = ", ".join(columns + ([f"`{decoded}` binary"] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        encoder = Encoder(words, pattern)
        for whole in batches:
            texts = whole.column(whole.num_columns - 1)
            for first, last in _blocks(texts):
                encoded = encoder.encode(texts.slice(first, last - first).to_pylist())
                for at in range(first, last, PASSED):
                    batch = whole.slice(at, min(PASSED, last - at))
                    ids = list(islice(encoded, batch.num_rows))
                    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                    out = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))]
                    if decoded:
                        out.append(pa.array([words.decode(i.astype(np.int64)) for i in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=[*keep, name, *[decoded] * bool(decoded)])

    return df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_whole")).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes of its lists of ids."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, PASSED):
                batch = whole.slice(at, PASSED)
                lists = batch.column(batch.schema.get_field_index(ids))
                texts = []
                for i in range(len(lists)):
                    values = lists[i].values
                    texts.append(words.decode(values.to_numpy(zero_copy_only=False).astype(np.int64)) if values is not None else b"")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, name])

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
