"""Session settings the operators expect."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins on measured sizes and splits skewed join partitions. Attribute maps
# follow dictionary semantics (the last of two equal keys wins).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}
# Rows one task should hold of a time-ordered group; hotter groups are cut into time bins.
ROWS_PER_BIN_KEY = "spark.stepscope.rowsPerBin"
ROWS_PER_BIN_DEFAULT = 1_000_000


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def rows_per_bin(spark: SparkSession) -> int:
    """Target rows per time bin, from the session."""
    return int(spark.conf.get(ROWS_PER_BIN_KEY, str(ROWS_PER_BIN_DEFAULT)))



def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``; only a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.gettempdir(), "stepscope")
    return f"{folder.rstrip('/')}/stepscope-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, as a table in the shared checkpoint folder.

    The table outlives lost executors and keeps column pruning for its readers.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table
