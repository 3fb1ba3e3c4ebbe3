"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the folder named by ``spark.checkpoint.dir`` and read it back.

    Compact, and the plan starts anew from files that outlive any executor. Where the cluster names no folder
    and the master is local, a temporary folder stands in for it. The files are left to the folder's owner.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        folder = tempfile.mkdtemp(prefix="tamis-tables-")
    path = f"{folder.rstrip('/')}/tamis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
