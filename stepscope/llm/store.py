"""Stored intermediates and session settings held for one step."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# Inner joins of texts with few of them: Spark's own Bloom filter (at most 8 MB, whatever the sizes) prunes texts before they are shuffled.
PRUNE = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
         "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
         "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Hold session settings while the block runs."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, **more: str) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder and read it back.

    The written files survive lost executors. Shuffle files of the write are dropped when it ends, so the disk a
    query needs is that of its largest step, not of all steps.
    """
    with settings(df.sparkSession, CLEANUP | more):
        return materialize(df)


def drop(*tables: DataFrame) -> None:
    """Delete stored intermediates that nothing reads any more: neither a later step nor the plan of a result."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
