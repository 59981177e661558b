"""Embedding rows as numpy blocks."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4096


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose vectors have one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def bounded_rows(vectors: DataFrame, id_column: str, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows in the order of a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64(id_column), id_column).limit(most).select(id_column, "embedding").collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


def bounded_sample(vectors: DataFrame, id_column: str, most: int = SAMPLE) -> np.ndarray:
    """The vectors of :func:`bounded_rows`."""
    rows = vectors.orderBy(F.xxhash64(id_column), id_column).limit(most).select("embedding").collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def in_blocks(vectors: DataFrame, id_column: str, size: int, count: int) -> DataFrame:
    """Deal rows to ``block`` 0 to count // size by a hash of the id."""
    return vectors.withColumn("block", F.pmod(F.xxhash64(id_column, F.lit(11)), F.lit(max(1, -(-count // size)))).cast("int"))
