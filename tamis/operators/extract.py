"""Feature extraction: new numeric columns from the fitted sample; other features disappear."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.linear import principal_axes
from tamis.functions.schema import carried_columns, numeric_columns, quoted
from tamis.functions.stats import moments, summaries
from tamis.operators.base import Settings, Stage, register, training_sample

EXPRESSION_TERMS = 600
MI_BINS = 32
LIFTED_ROWS = 4_096


def _inputs(df: DataFrame, s: Settings) -> tuple[list[str], DataFrame]:
    columns = numeric_columns(df, s.label)
    if not columns:
        raise ValueError("no numeric columns for feature extraction")
    return columns, training_sample(df, s.degree)


def _output(df: DataFrame, s: Settings, columns: list[str], make) -> DataFrame:
    """``make`` maps the table to named expressions; fitted columns it lacks count as 0."""
    lacking = [c for c in columns if c not in df.columns]
    full = df.select("*", *[F.lit(0.0).alias(c) for c in lacking])
    return full.select(*[quoted(c) for c in carried_columns(df, s.label)], *make(full))


def _project(columns: list[str], centre, scale, weights, names: list[str]):
    """Linear projections: expressions while they are small, otherwise one Arrow-batched product."""
    w = np.asarray(weights, dtype=float) / np.asarray(scale, dtype=float)[None, :]
    shift = w @ np.asarray(centre, dtype=float)
    x = [quoted(c).cast("double") for c in columns]
    if w.size <= EXPRESSION_TERMS:

        def make(full: DataFrame) -> list[Column]:
            out = []
            for row, at, name in zip(w, shift, names):
                total = F.lit(-float(at))
                for value, col in zip(row, x):
                    total = total + F.lit(float(value)) * col
                out.append(total.alias(name))
            return out

        return make

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vectors.to_numpy()) @ w.T - shift))

    def make(full: DataFrame) -> list[Column]:
        projected = product(F.array(*x))
        return [projected[i].alias(name) for i, name in enumerate(names)]

    return make


def _scaled(sample: DataFrame, columns: list[str]):
    n, mean, cov = moments(sample, [quoted(c) for c in columns])
    std = np.sqrt(np.diag(cov))
    std = np.where(std > 0, std, 1.0)
    return n, mean, std, cov / np.outer(std, std)


def _linear_state(columns, centre, scale, axes, names) -> dict:
    return {
        "columns": columns,
        "centre": list(map(float, centre)),
        "scale": list(map(float, scale)),
        "axes": [list(map(float, a)) for a in axes],
        "names": names,
    }


def apply_linear(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    make = _project(state["columns"], state["centre"], state["scale"], state["axes"], state["names"])
    return _output(df, s, state["columns"], make)


def fit_pca(df: DataFrame, s: Settings) -> dict:
    """Components of the standardized columns up to the wanted share of variance."""
    columns, sample = _inputs(df, s)
    _, mean, std, corr = _scaled(sample, columns)
    values, axes = principal_axes(corr)
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    if isinstance(s.n_components, float) and s.n_components < 1:
        k = int(np.searchsorted(share, s.n_components, side="right")) + 1
    else:
        k = int(s.n_components)
    k = min(max(1, k), len(columns))
    state = _linear_state(columns, mean, std, axes[:k], [f"PC{i + 1}" for i in range(k)])
    state["variance"] = values.tolist()
    return state


def wanted_components(n_components, columns: int, most: int) -> int:
    """A number of components, or a share of the columns; from 1 to ``most``."""
    asked = math.ceil(columns * n_components) if 0 < n_components < 1 else int(n_components)
    return min(max(asked, 1), max(most, 1))


def fit_fixed_pca(df: DataFrame, s: Settings) -> dict:
    """A fixed number of components; solver names share this covariance path."""
    columns, sample = _inputs(df, s)
    n, mean, std, corr = _scaled(sample, columns)
    if min(len(columns), n) < 2:
        return _linear_state(columns, mean, std, np.eye(len(columns))[:1], [f"{s.method}_1"])
    rank = min(len(columns), n)
    k = wanted_components(s.n_components, len(columns), rank - 1 if s.method == "pca_arpack" else rank)
    values, axes = principal_axes(corr)
    state = _linear_state(columns, mean, std, axes[:k], [f"{s.method}_{i + 1}" for i in range(k)])
    state["variance"] = values.tolist()
    return state


def fit_svd(df: DataFrame, s: Settings) -> dict:
    """Scaled but not centred: axes of the second moments."""
    columns, sample = _inputs(df, s)
    p = len(columns)
    k = s.n_components
    if isinstance(k, float):
        if not 0 < k < 1:
            raise ValueError("n_components as float must be in (0, 1)")
        k = math.ceil(p * k)
    k = min(max(1, int(k)), p - 1) if p > 1 else 1
    _, mean, std, corr = _scaled(sample, columns)
    values, axes = principal_axes(corr + np.outer(mean / std, mean / std))
    state = _linear_state(columns, np.zeros(p), std, axes[:k], [f"SVD{i + 1}" for i in range(k)])
    state["variance"] = values.tolist()
    return state


# --- supervised filter ----------------------------------------------------------------------------


def fit_cfs(df: DataFrame, s: Settings) -> dict:
    """Columns scoring at least a share of the best score: F statistic, or mutual information for texts."""
    columns, sample = _inputs(df, s)
    if s.label is None:
        raise ValueError("cfs needs the label option")
    if isinstance(df.schema[s.label].dataType, T.StringType):
        scores = _mutual_information(sample, columns, s.label)
    else:
        scores = _f_scores(sample, columns, s.label)
    best = max(scores.values())
    return {
        "columns": columns,
        "scores": scores,
        "keep": [c for c in columns if scores[c] >= s.cfs_threshold * best],
    }


def _f_scores(sample: DataFrame, columns: list[str], label: str) -> dict[str, float]:
    y = quoted(label).cast("double")
    row = sample.agg(
        F.count(y).alias("n"),
        F.stddev_pop(y).alias("sy"),
        *[f(c, y).alias(f"{tag}{i}") for i, name in enumerate(columns) for c in [quoted(name).cast("double")] for tag, f in
          (("s", lambda c, y: F.stddev_pop(c)), ("c", lambda c, y: F.covar_pop(c, y)))],
    ).first()
    out = {}
    for i, c in enumerate(columns):
        scale = (row[f"s{i}"] or 0.0) * (row["sy"] or 0.0)
        r2 = min((row[f"c{i}"] / scale) ** 2, 1.0) if scale > 0 else 0.0
        out[c] = r2 / (1.0 - r2) * (row["n"] - 2) if r2 < 1.0 else math.inf
    return out


def _mutual_information(sample: DataFrame, columns: list[str], label: str) -> dict[str, float]:
    """Mutual information of equal-width bins and classes, from one grouped count."""
    bounds = summaries(sample, {c: quoted(c).cast("double") for c in columns}, {"lo": F.min, "hi": F.max})
    cells = []
    for i, c in enumerate(columns):
        low, width = bounds[c]["lo"], (bounds[c]["hi"] - bounds[c]["lo"]) / MI_BINS
        x = quoted(c).cast("double")
        code = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(MI_BINS - 1)) if width > 0 else F.lit(0)
        cells.append(F.struct(F.lit(i).alias("c"), code.cast("int").alias("b")))
    counts = (
        sample.select(quoted(label).alias("y"), F.explode(F.array(*cells)).alias("cell"))
        .select("y", "cell.*")
        .groupBy("c", "b", "y")
        .count()
    )

    def terms(*keys: str) -> DataFrame:
        """Sum of n log n over the cells of each column, one row per column."""
        cells = counts.groupBy("c", *keys).agg(F.sum("count").cast("double").alias("m"))
        return cells.groupBy("c").agg(F.sum(F.col("m") * F.log("m")).alias("t"), F.sum("m").alias("n"))

    parts = [{r["c"]: (r["t"], r["n"]) for r in terms(*keys).collect()} for keys in (("b", "y"), ("b",), ("y",))]
    out = {}
    for i, c in enumerate(columns):
        if i not in parts[0]:
            out[c] = 0.0
            continue
        (joint, n), (bins, _), (classes, _) = (part[i] for part in parts)
        out[c] = (joint - bins - classes) / n + math.log(n)
    return out


def apply_kept(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[quoted(c) for c in carried_columns(df, s.label)], *[quoted(c) for c in state["keep"] if c in have]
    )


# --- generated products ---------------------------------------------------------------------------


def fit_products(df: DataFrame, s: Settings) -> dict:
    """Inputs by falling variance. ``max_generated_features``: raise where the columns would be more."""
    columns, sample = _inputs(df, s)
    squares = len(columns) if s.method == "polynomial" else 0
    made = len(columns) + squares + len(columns) * (len(columns) - 1) // 2
    if s.max_generated_features is not None and made > int(s.max_generated_features):
        raise ValueError(f"{made} columns would be generated, more than max_generated_features")
    spread = summaries(sample, {c: quoted(c).cast("double") for c in columns}, {"v": F.var_samp})
    ranked = sorted(columns, key=lambda c: (-(spread[c]["v"] if spread[c]["v"] is not None else -1.0), columns.index(c)))
    return {"columns": ranked}


def apply_products(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    columns = state["columns"]

    def make(full: DataFrame) -> list[Column]:
        x = {c: quoted(c).cast("double") for c in columns}
        out = [x[c].alias(c) for c in columns]
        for i, a in enumerate(columns):
            for b in columns[i:]:
                if a != b:
                    out.append((x[a] * x[b]).alias(f"{a} {b}"))
                elif s.method == "polynomial":
                    out.append((x[a] * x[a]).alias(f"{a}^2"))
        return out

    return _output(df, s, columns, make)


# --- kernel components ----------------------------------------------------------------------------


def fit_kernel(df: DataFrame, s: Settings) -> dict:
    """Kernel components: random Fourier features of the RBF kernel, and the principal axes of all sampled rows' features."""
    columns, sample = _inputs(df, s)
    n, mean, std, _ = _scaled(sample, columns)
    if min(len(columns), n) < 2:
        return _linear_state(columns, mean, std, np.eye(len(columns))[:1], [f"{s.method}_1"])
    rng = np.random.default_rng(int(s.seed))
    wanted = int(s.kernel_features)
    frequencies = rng.normal(scale=math.sqrt(2.0 / len(columns)), size=(wanted, len(columns)))
    phases = rng.uniform(0, 2 * math.pi, wanted)
    state = {"columns": columns, "centre": mean.tolist(), "scale": std.tolist(), "frequencies": frequencies.tolist(), "phases": phases.tolist()}
    centre, cov = _lifted_moments(sample.select(F.array(*[quoted(c).cast("double") for c in columns]).alias("x")), state)
    _, axes = principal_axes(cov)
    k = wanted_components(s.n_components, len(columns), min(wanted, n))
    return state | {
        "offset": centre.tolist(),
        "weights": axes[:k].tolist(),
        "names": [f"{s.method}_{i + 1}" for i in range(k)],
    }


def _blocks_of(vectors: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The vectors of a list column in blocks that stay in the cache; missing numbers are NaN."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)
    for at in range(0, len(values), LIFTED_ROWS):
        yield values[at : at + LIFTED_ROWS]


def _waves(state: dict):
    """Random Fourier features of rows of numbers."""
    centre, scale = np.array(state["centre"]), np.array(state["scale"])
    frequencies, phases = np.array(state["frequencies"]), np.array(state["phases"])
    return lambda values: math.sqrt(2.0 / len(phases)) * np.cos((values - centre) / scale @ frequencies.T + phases)


def _pooled(a: tuple, b: tuple) -> tuple:
    """Rows, mean and centred products of two sets of rows together (Chan, Golub & LeVeque 1979)."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _lifted_moments(vectors: DataFrame, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of the features of all rows without gaps, in one pass.

    A task sends the sums of its rows, whose size does not depend on them; a tree of tasks adds them up.
    """
    waves, width = _waves(state), len(state["columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for values in _blocks_of(batch.column(0), width):
                values = values[~np.isnan(values).any(axis=1)]
                if len(values):
                    lifted = waves(values)
                    mean = lifted.mean(axis=0)
                    lifted -= mean
                    part = len(lifted), mean, lifted.T @ lifted
                    total = part if total is None else _pooled(total, part)
        if total is not None:
            columns = [pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "mean", "products"])

    def unpacked(row) -> tuple:
        mean = np.frombuffer(row["mean"])
        return row["n"], mean, np.frombuffer(row["products"]).reshape(len(mean), -1)

    n, mean, products = vectors.mapInArrow(run, "n long, mean binary, products binary").rdd.map(unpacked).treeReduce(_pooled)
    return mean, products / n


def apply_kernel(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    if "frequencies" not in state:
        return apply_linear(df, s, state)
    weights, offset, waves = np.array(state["weights"]), np.array(state["offset"]), _waves(state)
    width = len(state["columns"])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def components(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            parts = [(waves(values) - offset) @ weights.T for values in _blocks_of(vectors, width)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(weights)))
            ends = np.arange(0, found.size + 1, len(weights), dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, pa.array(found.ravel(), from_pandas=True))

    def make(full: DataFrame) -> list[Column]:
        found = components(F.array(*[quoted(c).cast("double") for c in state["columns"]]))
        return [found[i].alias(name) for i, name in enumerate(state["names"])]

    return _output(df, s, state["columns"], make)


# --- random trees ---------------------------------------------------------------------------------


def _unit(seed, *parts) -> float:
    text = ":".join(str(p) for p in (seed, *parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def fit_random_trees(df: DataFrame, s: Settings) -> dict:
    """Trees split at random: a drawn column and a drawn point between its bounds within the node.

    One grouped min/max per level serves all trees.
    """
    columns, sample = _inputs(df, s)
    trees, depth = int(s.random_tree_estimators), int(s.random_tree_depth)
    wide = sample.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    # node number within its tree: root 1, children 2n and 2n+1; None marks a leaf
    nodes: dict[tuple[int, int], tuple[int, float] | None] = {}
    level = [(t, 1) for t in range(trees)]
    for _ in range(depth):
        picks = {key: int(_unit(s.seed, "column", *key) * len(columns)) for key in level}
        items = []
        for t in range(trees):
            mine = [node for tree, node in level if tree == t]
            if mine:
                items.append((t, _tree_place(t, nodes, lambda i: F.col(f"x{i}")), mine))
        cells = F.array(
            *[
                F.struct(F.lit(t).alias("t"), place.alias("node"), _picked(place, mine, picks, t).alias("x"))
                for t, place, mine in items
            ]
        )
        rows = (
            wide.select(F.explode(cells).alias("cell"))
            .select("cell.*")
            .groupBy("t", "node")
            .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()
        )
        bounds = {(r["t"], r["node"]): (r["lo"], r["hi"]) for r in rows}
        following = []
        for key in level:
            low, high = bounds.get(key, (None, None))
            if low is None or low == high:
                nodes[key] = None
                continue
            nodes[key] = (picks[key], low + _unit(s.seed, "point", *key) * (high - low))
            following += [(key[0], 2 * key[1]), (key[0], 2 * key[1] + 1)]
        level = following
        if not level:
            break
    for key in level:
        nodes[key] = None
    leaves = sorted(key for key, cut in nodes.items() if cut is None)
    return {
        "columns": columns,
        "nodes": [[t, node, *(cut or [None, None])] for (t, node), cut in sorted(nodes.items())],
        "leaves": [list(key) for key in leaves],
    }


def _picked(place: Column, mine: list[int], picks: dict, t: int) -> Column:
    value = F.lit(None).cast("double")
    for node in mine:
        value = F.when(place == node, F.col(f"x{picks[(t, node)]}")).otherwise(value)
    return value


def _tree_place(t: int, nodes: dict, column) -> Column:
    """Node number a row reaches in tree ``t`` with the cuts known so far."""

    def below(node: int) -> Column:
        cut = nodes.get((t, node))
        if cut is None:
            return F.lit(node)
        return F.when(column(cut[0]) <= F.lit(cut[1]), below(2 * node)).otherwise(below(2 * node + 1))

    return below(1)


def apply_random_trees(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    nodes = {(t, node): None if c is None else (c, cut) for t, node, c, cut in state["nodes"]}
    columns = state["columns"]

    def make(full: DataFrame) -> list[Column]:
        places = {t: _tree_place(t, nodes, lambda i: quoted(columns[i]).cast("double")) for t in {k[0] for k in nodes}}
        return [
            F.when(places[t] == node, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"RTE{i + 1}")
            for i, (t, node) in enumerate(state["leaves"])
        ]

    return _output(df, s, columns, make)


@register
class FeatureExtraction(Stage):
    """Methods ``pca truncated_svd (svd, tsvd) cfs polynomial interaction incremental_pca kernel_pca
    random_trees_embedding pca_arpack pca_randomized``."""

    STAGE = "feature_extraction"
    METHODS = {
        "pca": (fit_pca, apply_linear),
        "truncated_svd": (fit_svd, apply_linear),
        "svd": (fit_svd, apply_linear),
        "tsvd": (fit_svd, apply_linear),
        "cfs": (fit_cfs, apply_kept),
        "polynomial": (fit_products, apply_products),
        "interaction": (fit_products, apply_products),
        "incremental_pca": (fit_fixed_pca, apply_linear),
        "pca_arpack": (fit_fixed_pca, apply_linear),
        "pca_randomized": (fit_fixed_pca, apply_linear),
        "kernel_pca": (fit_kernel, apply_kernel),
        "random_trees_embedding": (fit_random_trees, apply_random_trees),
    }
    OPTIONS = {
        "n_components": 0.95,
        "cfs_threshold": 0.3,
        "max_generated_features": None,
        "kernel_features": 128,
        "random_tree_estimators": 20,
        "random_tree_depth": 3,
        "seed": 0,
    }

