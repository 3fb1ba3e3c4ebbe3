"""Quality classifier: a generalised additive model with pairwise interactions.

The score of a text is the logistic of an intercept, one lookup table per feature and one per chosen pair of
features. Tables are learnt by cyclic boosting: round after round, each feature in turn gets one shallow tree
fitted to the gradients of the logistic loss and adds a small share of it to its table, so no feature can
take what another explains as well. Then pairs of features are ranked by how much one tree over both would
still gain, and the best are boosted in the same way. Scoring is binning and adding table entries.

Features are figures of the text alone. The model is fitted on at most ``Settings.sample`` labelled rows,
chosen by a hash of their id; this bound is the only part that does not grow with the data. Everything else,
features and scores, is row-local over all documents.

Defined cases: a null text is an empty one and gets a score as any; rows whose label or id is null teach
nothing; without usable labels every score is 0.5, and with one class alone its smoothed share; repeated
rows are scored each on its own; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_words", "word_length", "distinct_words", "distinct_pairs", "top_word", "same_in_a_row", "capitals", "symbols", "separators",
    "exclamations", "digits", "non_ascii", "closed_lines", "repeated_lines", "words_per_line", "marks",
)
ROWS = 512  # texts handled together
_NOISE = [bytes([b]) for b in b"#*$%&<>"]
_DIGITS = b"0123456789"
_HIGH = bytes(range(128, 256))
_MARKS = b".,;:!?"


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled rows the model is fitted on, at most
    bins: int = 32
    rounds: int = 200
    rate: float = 0.08
    splits: int = 3  # of a tree over one feature
    pairs: int = 8
    pair_bins: int = 8
    pair_rounds: int = 60
    ridge: float = 5.0


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, rows[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], rows[:, a], side="right"), np.searchsorted(self.coarse[b], rows[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def features(text: bytes) -> tuple[float, ...]:
    """The figures of one UTF-8 text in the order of ``FEATURES``."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [line for line in (x.rstrip() for x in text.split(b"\n")) if line]
    m = max(1, len(lines))
    marks = size - len(text.translate(None, _MARKS)) if text else 0
    return (
        float(np.log1p(len(words))),
        size / n,
        len(counts) / n,
        len(set(zip(words, words[1:]))) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(map(text.count, _NOISE)) / n,
        text.count(b"|") / n,
        text.count(b"!!") / n,
        (len(text) - len(text.translate(None, _DIGITS))) / size,
        (len(text) - len(text.translate(None, _HIGH))) / size,
        sum(line.endswith((b".", b"?", b"!", b'"')) for line in lines) / m,
        (len(lines) - len(set(lines))) / m,
        n / m,
        marks / n,
    )


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most ``bins`` bins with about as many rows each."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.zeros(0)


def _gain(g, h, ridge: float):
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Leaf values per bin of a tree with at most ``splits`` splits, the best split of any leaf first."""
    leaves = [(0, len(g))]
    sums_g, sums_h = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    for _ in range(splits):
        best = (1e-9, None, None)
        for leaf in leaves:
            first, last = leaf
            at = np.arange(first + 1, last)
            if len(at):
                left_g, left_h = sums_g[at] - sums_g[first], sums_h[at] - sums_h[first]
                all_g, all_h = sums_g[last] - sums_g[first], sums_h[last] - sums_h[first]
                gains = _gain(left_g, left_h, ridge) + _gain(all_g - left_g, all_h - left_h, ridge) - _gain(all_g, all_h, ridge)
                top = int(np.argmax(gains))
                if gains[top] > best[0]:
                    best = (gains[top], leaf, int(at[top]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(len(g))
    for first, last in leaves:
        values[first:last] = -(sums_g[last] - sums_g[first]) / (sums_h[last] - sums_h[first] + ridge)
    return values


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both axes of a grid once."""
    best, values = 0.0, np.zeros(g.shape)
    sums_g, sums_h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    rows, columns = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    if len(rows) and len(columns):
        def quarters(s: np.ndarray) -> list[np.ndarray]:
            low = s[1:-1, 1:-1]
            top, side = np.broadcast_to(s[1:-1, -1:], low.shape), np.broadcast_to(s[-1:, 1:-1], low.shape)
            return [low, top - low, side - low, s[-1, -1] - top - side + low]

        parts = list(zip(quarters(sums_g), quarters(sums_h)))
        gains = sum(_gain(a, b, ridge) for a, b in parts) - _gain(sums_g[-1, -1], sums_h[-1, -1], ridge)
        i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
        best = float(gains[i, j])
        leaf = [-a[i, j] / (b[i, j] + ridge) for a, b in parts]
        values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf
    return best, values


def fit(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Cyclic boosting over the features, then over the pairs that still gain most."""
    if not len(rows):
        return Model()
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(intercept=float(np.log(share / (1 - share))))
    total = np.full(len(rows), model.intercept)
    width = rows.shape[1]
    model.edges = [cuts(rows[:, j], settings.bins) for j in range(width)]
    model.coarse = [cuts(rows[:, j], settings.pair_bins) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if labels.min() == labels.max():
        return model
    bins = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(model.coarse)]

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - labels, p * (1 - p)

    for _ in range(settings.rounds):
        for j in range(width):
            g, h = gradients()
            n = len(model.tables[j])
            step = settings.rate * shallow_tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n), settings.splits, settings.ridge)
            model.tables[j] += step
            total += step[bins[j]]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = coarse[a] * sizes[b] + coarse[b], sizes[a] * sizes[b]
        return np.bincount(at, g, n).reshape(sizes[a], sizes[b]), np.bincount(at, h, n).reshape(sizes[a], sizes[b])

    g, h = gradients()
    ranked = sorted(((pair_tree(*grid(a, b, g, h), settings.ridge)[0], a, b) for a, b in combinations(range(width), 2)), reverse=True)
    chosen = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[: settings.pairs] if gain > 0]
    for _ in range(settings.pair_rounds):
        for a, b, table in chosen:
            step = settings.rate * pair_tree(*grid(a, b, *gradients()), settings.ridge)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    model.pairs = chosen
    return model


def remainder(key: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def with_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[key, "features"])

    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_whole")).mapInArrow(run, f"`{key}` {kind}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Fit on the labelled documents of ``labels`` (already without held-out rows), at most ``settings.sample``."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_label"))
    drawn = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(settings.sample)
    # broadcast: never more rows than settings.sample
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id", "left_semi")
    measured = with_features(rows, "_id", "_text").join(F.broadcast(drawn), "_id").orderBy("_id").toArrow()
    table = np.array(measured.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(table, measured.column("_label").to_numpy(), settings)


def score_documents(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score) of every row."""
    columns = [key, *keep]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            rows = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(rows))], names=[*columns, "score"])

    return df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_whole")).mapInArrow(run, schema)


def keep_good(df: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                rows = np.array([features(t or b"") for t in texts], np.float64).reshape(-1, len(FEATURES))
                yield batch.filter(pa.array(model.score(rows) >= threshold))

    return df.mapInArrow(run, df.schema)
