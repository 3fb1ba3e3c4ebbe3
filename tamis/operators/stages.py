"""All stages, in the order a plan runs them."""

from tamis.operators.dedup import DuplicateDetection
from tamis.operators.encode import FeatureEncoding
from tamis.operators.extract import FeatureExtraction
from tamis.operators.impute import Imputation
from tamis.operators.normalize import Normalization
from tamis.operators.outlier import OutlierDetection
from tamis.operators.select import FeatureSelection

STAGE_ORDER = [
    DuplicateDetection,
    FeatureEncoding,
    Imputation,
    Normalization,
    OutlierDetection,
    FeatureExtraction,
    FeatureSelection,
]

__all__ = [cls.__name__ for cls in STAGE_ORDER] + ["STAGE_ORDER"]
