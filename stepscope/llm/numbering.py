"""Gapless numbers in a global order, without gathering a key in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of the table has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key from 0, ordered by ``order``; rows equal in all of these may be numbered in any order.

    Rows are dealt by ranges of (keys, order, a tie-break that differs in every row), so a hot key or many equal rows spread over
    tasks. Ranks inside a range are added to the key's counts in the ranges before it, of which there is one row per key and range.
    The input should be a stored table: it is read once for the bounds and once to be dealt.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = stored(dealt.repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order, "_tie")) - 1
    same: Column = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranged.withColumn("_rank", rank).join(bases, same)
    return joined.select(*rows.columns, (F.col("_base") + F.col("_rank")).cast("long").alias(name))
