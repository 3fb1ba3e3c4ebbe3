"""Benchmark decontamination by the q-gram lemma.

A text holds an item if some stretch of it turns into the item with at most ``budget`` edits. Such a stretch
shares at least ``m - q + 1 - q * budget`` of the item's q-grams, and their diagonals (place in the text minus
place in the item) lie within ``budget`` of each other. So

1. q-grams of a text are looked up among those of the items,
2. hits are counted per item in diagonal bands twice as wide as a budget, each overlapping the next by half,
3. bands that reach the bound are aligned: a banded edit distance with free ends in the text.

Texts are compared in lower case with single spaces; places count code points of that form. The items are the
stated query set: they are handled in blocks of about ``BLOCK`` bytes, each sent to all tasks, and every block
meets all texts. Work on texts is row-local: no shuffle, so copies and hot sources are spread as the input is.

Defined cases: null and empty items match nothing; items shorter than ``q`` must occur as they are; a null
text is an empty one and holds nothing; an item is reported once per row with its fewest edits, and of those
its first place; repeated rows and equal ids are judged each on its own; empty tables give empty results; only the id
and text columns of both tables are read by the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
RATE = 0.08  # edits per character of an item
BLOCK = 8 << 20  # bytes of items sent to the tasks together
CHUNK = 1 << 20  # characters searched together
ROWS = 512  # texts handled together
BITS = 20
SLOT_BITS = 18
MULTIPLIER = np.uint32(0x9E3779B1)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit polynomial hash of each q-gram, by doubling."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out, done, step, power, block = np.zeros(n, np.uint32), 0, 1, MULTIPLIER, x
    while step <= q:
        if q & step:
            out = out * power + block[done : done + n]
            done += step
        if 2 * step <= q:
            block = block[:-step] * power + block[step:]
            power = np.uint32(int(power) ** 2 & 0xFFFFFFFF)
        step *= 2
    return out * MULTIPLIER


def budget_of(size: int, q: int, rate: float) -> int:
    """The edit budget of an item; small enough that the lemma asks for at least one q-gram."""
    return max(0, min(math.floor(rate * size), (size - q) // q))


@dataclass
class Item:
    id: object
    text: str
    codes: np.ndarray
    budget: int
    bound: int


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]], q: int, rate: float):
        self.q, self.items = q, []
        for key, text in items:
            text = normalised(text or "")
            if text:
                budget = budget_of(len(text), q, rate)
                self.items.append(Item(key, text, codes(text), budget, len(text) - q + 1 - q * budget))
        self.short = [i for i, item in enumerate(self.items) if len(item.text) < q]
        grams = [gram_hashes(item.codes, q) for item in self.items]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint32)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.hashes >> np.uint32(32 - BITS)] = True
        self.width = np.array([item.budget + 1 for item in self.items], np.int64)
        self.bounds = np.array([item.bound for item in self.items], np.int64)

    def bands(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(text, item, band) of the bands whose hits reach the bound. ``starts``: where the texts begin in ``x``."""
        hashes = gram_hashes(x, self.q)
        at = np.flatnonzero(self.seen[hashes >> np.uint32(32 - BITS)])
        first, last = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
        times = last - first
        where = np.repeat(at, times)
        entry = np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        item = self.owner[entry]
        text = np.searchsorted(starts, where, side="right") - 1
        # most items have too few hits in a text on all diagonals together; slots they share only add to that
        slot = (text * 1_000_003 + item) & ((1 << SLOT_BITS) - 1)
        enough = np.bincount(slot, minlength=1)[slot] >= self.bounds[item]
        where, entry, item, text = where[enough], entry[enough], item[enough], text[enough]
        diagonal = where - starts[text] - self.place[entry]
        band = diagonal // self.width[item]
        rows = np.stack([np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(self.place[entry], 2)], axis=1)
        if not len(rows):
            return rows[:, :3]
        rows = np.unique(rows, axis=0)[:, :3]  # a q-gram of the item counts once a band
        head = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
        count = np.diff(np.append(head, len(rows)))
        return rows[head][count >= self.bounds[rows[head, 1]]]


FAR = 1 << 30


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, free: bool, most: int) -> tuple[int, int]:
    """(edits, end) of the cheapest alignment of the pattern that stays on diagonals ``low`` to ``high``.

    It may begin anywhere on the band if ``free``, else at diagonal 0; it may end anywhere. Earliest end of equals.
    More than ``most`` edits are given as ``FAR``.
    """
    diagonals = np.arange(low, high + 1)
    reached = np.arange(len(pattern) + 1)[:, None] + diagonals  # characters of the text used up, by row and diagonal
    inside = (reached >= 0) & (reached <= len(text))
    padded = np.append(text, np.zeros(1, text.dtype))
    differ = (padded[np.minimum(np.maximum(reached[:-1], 0), len(text))] != pattern[:, None]).astype(np.int64)
    differ[~inside[:-1] | (reached[:-1] == len(text))] = FAR
    outside = np.where(inside, 0, FAR)
    cost = outside[0] + (0 if free else np.where(diagonals == 0, 0, FAR))
    steps = np.arange(len(diagonals))
    skipped = np.full(len(diagonals), FAR)
    for along, out in zip(differ, outside[1:]):
        along = along + cost
        skipped[:-1] = cost[1:] + 1
        cost = np.minimum.accumulate(np.minimum(along, skipped) + out - steps) + steps + out  # then extra characters of the text
        if cost.min() > most:
            return FAR, 0
    least = int(np.argmin(cost))
    return int(cost[least]), len(pattern) + int(diagonals[least])


def occurrence(item: Item, text: str, band: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item on a band of a normalised text, if within its budget."""
    width, size = item.budget + 1, len(item.text)
    low, high = band * width - item.budget, (band + 2) * width + item.budget
    begin, stop = max(0, low), min(len(text), high + size + item.budget)
    exact = text.find(item.text, begin, stop)
    if exact >= 0:
        return 0, exact, exact + size
    if not item.budget:
        return None
    region = codes(text[begin:stop])
    edits, end = banded(item.codes, region, low - begin, high - begin, True, item.budget)
    if edits > item.budget:
        return None
    _, back = banded(item.codes[::-1], region[:end][::-1], -item.budget, item.budget, False, edits)
    return edits, begin + end - back, begin + end


def search(index: Index, texts: list[str]) -> Iterator[tuple[int, object, int, int, int]]:
    """(text, item id, start, end, edits) of all items found in normalised texts."""
    first = 0
    while first < len(texts):
        last, volume = first, 0
        while last < len(texts) and (last == first or volume + len(texts[last]) <= CHUNK):
            volume += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        sizes = np.array([len(t) + 1 for t in part])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, band in index.bands(codes("\x00".join(part)), np.cumsum(sizes) - sizes).tolist():
            found = occurrence(index.items[item], part[text], band)
            if found is not None and found < best.get((text, item), (FAR, 0, 0)):
                best[text, item] = found
        for item in index.short:
            for text, value in enumerate(part):
                at = value.find(index.items[item].text)
                if at >= 0:
                    best[text, item] = (0, at, at + len(index.items[item].text))
        for (text, item), (edits, start, end) in sorted(best.items()):
            yield first + text, index.items[item].id, start, end, edits
        first = last


def blocks(benchmark: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``size`` bytes."""
    rows = benchmark.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / size))
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == number) if count > 1 else rows
        yield [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block: int = BLOCK,
) -> DataFrame:
    """(id, item id, start, end, edits): the items that each row of ``docs`` holds."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, start int, end int, edits int"
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_whole"))
    out = None
    for items in blocks(benchmark, item_key, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, rate)
            for batch in batches:
                found = list(search(index, [normalised(t) for t in batch.column(1).to_pylist()]))
                if found:
                    row, item, start, end, edits = zip(*found)
                    ids = batch.column(0).take(pa.array(row, pa.int64()))
                    numbers = [pa.array(x, pa.int32()) for x in (start, end, edits)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item), *numbers], names=[key, item_key, "start", "end", "edits"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for items in blocks(benchmark, item_key, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, rate)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    texts = [normalised(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                    leaking = {row for row, *_ in search(index, texts)}
                    yield batch.filter(pa.array([i not in leaking for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
