"""Ranked lexical search: tiles of items times tiles of documents, as dense float64 products.

Scores are whole numbers. The terms of a tile of items form a compact vocabulary of its own; a tile of documents is
a dense matrix of impacts over that vocabulary, and one product of two matrices scores all pairs of both tiles. A
product takes so many columns of the vocabulary that no partial sum reaches 2^53, where float64 would round; the
parts are added as 64-bit integers. A task keeps the best documents of every item, ties included, so results do not
depend on tiles or order.

Items go in blocks of ``BLOCK_BYTES`` of text: the driver and the tasks hold one block. The documents are read twice
a block: for the document frequencies of its terms, and for the scores.

Defined results: a null text has no term; a document or an item without a term is no result and has none. Equal
items (id and text) are answered once. Documents with equal score come by id, null ids last; repeated rows are
documents of their own. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tables import stored

BLOCK_BYTES = 8 << 20
ITEM_TILE = 256
TERM_TILE = 2_048
DOC_TILE = 512
IMPACT = 1_000_000  # no impact reaches it: (10^9 tf) div (1000 tf + 20 m) with m >= 50
EXACT = 1 << 53
PENDING = 1 << 18

# terms are runs of ASCII digits and letters and of anything beyond ASCII; A-Z are lower-cased
_APART = bytes(c for c in range(128) if not chr(c).isalnum())
_TERMS = bytes.maketrans(_APART + bytes(range(65, 91)), b" " * len(_APART) + bytes(range(97, 123)))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


@dataclass
class Tile:
    """Up to ITEM_TILE items: their numbers, the terms they hold in ascending order, and their postings."""

    items: np.ndarray
    vocabulary: np.ndarray
    row: np.ndarray
    column: np.ndarray

    def weights(self, w: np.ndarray, low: int, high: int) -> np.ndarray:
        """Weights of the items over columns low to high of the vocabulary."""
        inside = (self.column >= low) & (self.column < high)
        out = np.zeros((len(self.items), high - low))
        out[self.row[inside], self.column[inside] - low] = w[self.vocabulary[self.column[inside]]]
        return out


def tiles(texts: list[bytes | None]) -> tuple[dict[bytes, int], list[Tile]]:
    """The vocabulary of a block of items and its tiles."""
    number: dict[bytes, int] = {}
    held = [np.array(sorted({number.setdefault(t, len(number)) for t in terms_of(text)}), np.int64) for text in texts]
    out = []
    for at in range(0, len(held), ITEM_TILE):
        mine = held[at : at + ITEM_TILE]
        vocabulary, column = np.unique(np.concatenate(mine), return_inverse=True)
        if len(vocabulary):
            out.append(Tile(np.arange(at, at + len(mine)), vocabulary, np.repeat(np.arange(len(mine)), [len(m) for m in mine]), column))
    return number, out


def _statistics(number: dict[bytes, int]):
    """Per task: (term, documents that hold it); term -1: documents with a term, -2: their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding: Counter = Counter()
        documents = length = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                documents += bool(words)
                length += len(words)
                holding.update(number.keys() & set(words))
        keys = [-1, -2, *(number[t] for t in holding)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([documents, length, *holding.values()], pa.int64())], names=["term", "n"])

    return run


def weights_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The k best documents of every item: highest score first, then the smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """``scores``: items of the tile by documents. What ties with the k-th score is kept."""
        bound = self.least[items]
        if scores.shape[1] > self.k:
            bound = np.maximum(bound, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        row, column = np.nonzero(scores >= bound[:, None])
        self.parts.append((items[row], scores[row, column], ids[column], no_id[column]))
        self.size += len(row)
        if self.size > PENDING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, ids, no_id = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, no_id, -score, item))
        item = item[order]
        first = np.searchsorted(item, item, side="left")
        order = order[np.arange(len(item)) - first < self.k]
        kept = tuple(np.concatenate(x)[order] for x in zip(*self.parts))
        full = np.bincount(kept[0], minlength=len(self.least)) == self.k
        last = np.append(kept[0][1:] != kept[0][:-1], True)
        ends = kept[0][last]
        self.least[ends[full[ends]]] = kept[1][last][full[ends]]
        self.parts, self.size = [kept], len(order)
        return kept


def score_tile(tile: Tile, w: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores of the tile's items in ``docs`` documents, from (term, document, impact) triples."""
    at = np.searchsorted(tile.vocabulary, term)
    met = tile.vocabulary[np.minimum(at, len(tile.vocabulary) - 1)] == term
    at, doc, impact = at[met], doc[met], impact[met]
    heaviest = max(1, int(w[tile.vocabulary].max()))
    width = max(1, min(TERM_TILE, (EXACT - 1) // (IMPACT * heaviest)))
    scores = np.zeros((len(tile.items), docs), np.int64)
    for low in range(0, len(tile.vocabulary), width):
        high = min(low + width, len(tile.vocabulary))
        inside = (at >= low) & (at < high)
        if inside.any():
            impacts = np.zeros((high - low, docs))
            impacts[at[inside] - low, doc[inside]] = impact[inside]
            scores += (tile.weights(w, low, high) @ impacts).astype(np.int64)
    return scores


def _ranking(number: dict[bytes, int], parts: list[Tile], w: np.ndarray, items: int, documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_TILE):
                batch = whole.slice(at, DOC_TILE)
                term, doc, tf, m = [], [], [], []
                for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    words = terms_of(text)
                    counts = Counter(words)
                    held = number.keys() & counts.keys()
                    term += [number[t] for t in held]
                    tf += [counts[t] for t in held]
                    doc += [i] * len(held)
                    m += [100 - 50 + (50 * len(words) * documents) // length] * len(held) if held else []
                if not term:
                    continue
                term, doc, tf, m = (np.array(x, np.int64) for x in (term, doc, tf, m))
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
                ids = batch.column(0)
                no_id = np.asarray(ids.is_null())
                keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for tile in parts:
                    best.offer(tile.items, score_tile(tile, w, term, doc, impact, batch.num_rows), keys, no_id)
        item, score, ids, no_id = best.settle()
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=no_id), pa.array(score, pa.int64())], names=["number", "doc_id", "score"]
            )

    return run


def _search_block(docs: DataFrame, rows: list, item_type: str, k: int) -> DataFrame:
    """Results of one block of items: rows of (id, text)."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"number int, item_id {item_type}")
    number, parts = tiles([None if r[1] is None else r[1].encode("utf-8", "replace") for r in rows])
    texts = docs.select("text")
    # two numbers and one per term of the block
    found = dict(texts.mapInArrow(_statistics(number), "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    documents, length = found.get(-1, 0), found.get(-2, 0)
    w = weights_of(np.array([found.get(i, 0) for i in range(len(number))], np.int64), documents)
    ranked = docs.select("doc_id", "text").mapInArrow(
        _ranking(number, parts, w, len(rows), documents, length, k), "number int, doc_id long, score long"
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # every task sends its k best of every item; they meet in some tasks first, then in one for each item
    several = math.isqrt(docs.rdd.getNumPartitions()) + 1
    some = Window.partitionBy("number", F.pmod(F.xxhash64("doc_id", "score"), F.lit(several))).orderBy(*order)
    all_of_item = Window.partitionBy("number").orderBy(*order)
    few = ranked.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(all_of_item)).where(F.col("rank") <= k)
    # one row per item of the block, which is bounded by BLOCK_BYTES
    return last.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of ``docs`` that score highest for each item, scores above 0.

    ``key`` is an integer column. Both tables have the text in ``text``.
    """
    wanted = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).distinct()
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    item_type = wanted.schema["item_id"].dataType.simpleString()
    # an item costs its text and its results
    total = wanted.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    if blocks <= 1:
        return _search_block(narrow, wanted.collect(), item_type, k)
    numbered = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item_id", "text").collect()
        if rows:
            part = stored(_search_block(narrow, rows, item_type, k))
            out = part if out is None else out.unionByName(part)
    return out
