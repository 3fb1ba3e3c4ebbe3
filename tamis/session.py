"""Session helpers: defaults for tests and the lineage cut used by iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tamis", cores: str = "*", partitions: int = 8, **conf) -> SparkSession:
    """Session for tests and the bench. A cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder named by ``spark.checkpoint.dir``.

    The folder must be shared by all executors. Only where the cluster sets none, and only when the
    master is local, a temporary folder stands in for it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
            folder = tempfile.mkdtemp(prefix="tamis-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
