"""Local outlier factor: training density by neighbour joins, then every split scored against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.keys import ROW_ID, in_sample
from tamis.functions.neighbours import nearest
from tamis.functions.quantiles import exact_quantiles
from tamis.functions.schema import feature_columns, no_nulls, numeric_columns, quoted
from tamis.operators.base import Settings, training_sample
from tamis.session import cut_lineage

DENSITY_FLOOR = 1e-10


def unit_vectors(df: DataFrame, columns: list[str], scale: dict, name: str) -> DataFrame:
    """``row_id`` and the robust-scaled direction, one projection per step.

    The extra coordinate keeps a zero row at cosine distance 1 of the others.
    """
    scaled = F.array(*[(quoted(c).cast("double") - F.lit(scale[c][0])) / F.lit(scale[c][1]) for c in columns])
    sized = df.select(ROW_ID, scaled.alias("__z")).select(
        ROW_ID, "__z", F.sqrt(F.aggregate("__z", F.lit(0.0), lambda a, v: a + v * v)).alias("__len")
    )
    inside = F.col("__len") > 0
    direction = F.when(inside, F.transform("__z", lambda v: v / F.when(inside, F.col("__len")))).otherwise(F.col("__z"))
    return sized.select(ROW_ID, F.concat(direction, F.array(F.when(inside, F.lit(0.0)).otherwise(F.lit(1.0)))).alias(name))


def _cosine(dist2: Column) -> Column:
    return dist2 / 2


def fit_lof(df: DataFrame, s: Settings) -> dict:
    columns = numeric_columns(df, s.label)
    features = feature_columns(df, s.label)
    clean = training_sample(df, s.degree).where(no_nulls(features))
    rows = clean.count()
    if not columns or not rows:
        return {"columns": []}
    q = exact_quantiles(clean, {c: quoted(c).cast("double") for c in columns}, [0.25, 0.5, 0.75])
    scale = {c: [v[1], (v[2] - v[0]) or 1.0] for c, v in q.items()}
    k = int(s.neighbours)
    dims = len(columns) + 1
    points = cut_lineage(unit_vectors(clean, columns, scale, "dv").withColumnRenamed(ROW_ID, "did"))
    pairs = cut_lineage(
        nearest(
            points.select(F.col("did").alias("qid"), F.col("dv").alias("qv"), F.lit(-1).alias("want")),
            points,
            k,
            dims,
            skip_self=True,
        ).select("qid", "did", _cosine(F.col("dist2")).alias("d"))
    )
    reach = pairs.groupBy(F.col("qid").alias("id")).agg(F.max("d").alias("kdist"))
    density = cut_lineage(_density(pairs, reach).join(reach, "id"))
    factors = _factor(pairs, density.select(F.col("id").alias("did"), F.col("lrd").alias("near")), density.select("id", "lrd"))
    cut = exact_quantiles(factors, {"score": -F.col("lof")}, [s.threshold])["score"][0]
    table = cut_lineage(points.join(density, F.col("did") == F.col("id")).select("did", "dv", "kdist", "lrd"))
    return {"columns": columns, "scale": scale, "k": k, "cut": cut, "table": table}


def _density(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    joined = pairs.join(reach.select(F.col("id").alias("did"), "kdist"), "did")
    return joined.groupBy(F.col("qid").alias("id")).agg(
        (1.0 / (F.avg(F.greatest("d", "kdist")) + DENSITY_FLOOR)).alias("lrd")
    )


def _factor(pairs: DataFrame, near: DataFrame, own: DataFrame) -> DataFrame:
    mean_near = pairs.join(near, "did").groupBy(F.col("qid").alias("id")).agg(F.avg("near").alias("near"))
    return mean_near.join(own, "id").select("id", (F.col("near") / F.col("lrd")).alias("lof"))


def lof_scores(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    """``(id, lof)`` of the complete rows of the sample, measured against the training table."""
    features = feature_columns(df, s.label)
    table = state["table"]
    rows = df.where(in_sample(s.degree) & no_nulls(features))
    queries = unit_vectors(rows, state["columns"], state["scale"], "qv").select(F.col(ROW_ID).alias("qid"), "qv", F.lit(-1).alias("want"))
    pairs = nearest(queries, table.select("did", "dv"), state["k"], len(state["columns"]) + 1).select(
        "qid", "did", _cosine(F.col("dist2")).alias("d")
    )
    joined = pairs.join(table.select("did", "kdist", "lrd"), "did")
    return joined.groupBy(F.col("qid").alias("id")).agg(
        (F.avg("lrd") * (F.avg(F.greatest("d", "kdist")) + DENSITY_FLOOR)).alias("lof")
    )


def apply_lof(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    """Rows with missing values are kept."""
    if not state["columns"]:
        return df
    outliers = lof_scores(df, s, state).where(-F.col("lof") < F.lit(state["cut"])).select(F.col("id").alias(ROW_ID))
    return df.join(outliers, ROW_ID, "left_anti").select(*[quoted(c) for c in df.columns])
