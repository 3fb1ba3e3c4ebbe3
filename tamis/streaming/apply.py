"""Fitted models are projections and filters, so they also run on a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tamis.operators.base import StageModel

# stages whose transform is row-local for every method but the listed ones
ROW_LOCAL = {
    "feature_encoding": set(),
    "imputation": {"KNN", "EM"},
    "data_normalization": set(),
    "outlier_detection": {"LOF"},
    "feature_extraction": set(),
    "feature_selection": set(),
}


def is_row_local(model: StageModel) -> bool:
    return model.stage in ROW_LOCAL and model.settings["method"] not in ROW_LOCAL[model.stage]


def transform_stream(stream: DataFrame, models: list[StageModel]) -> DataFrame:
    """Apply fitted stages to a keyed, split stream. Stages that compare rows are refused."""
    for model in models:
        if not is_row_local(model):
            raise ValueError(f"{model.stage} {model.settings['method']} compares rows and cannot run on a stream")
        stream = model.transform(stream)
    return stream
