import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from tamis.session import local_session

    session = local_session("tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def keyed_frame(spark):
    """Build a keyed frame from rows: (row_id, split, *features)."""

    def build(rows, schema, split=None):
        from pyspark.sql import functions as F

        from tamis.functions.keys import with_row_keys

        df = with_row_keys(spark.createDataFrame(rows, schema), ["id"]).drop("id")
        return df if "split" in df.columns else df.withColumn("split", F.lit(split or "train"))

    return build
