"""Labelled samples, folds and small models fitted in one task."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """``doc_id, text, label, place`` of at most ``most`` labelled rows, taken in the order of a hash of the id.

    The chosen labels have that bound and are broadcast, so only texts of the sample are shuffled. Labels other than 0 and 1 are left out;
    of several texts with one doc_id the smallest is taken.
    """
    chosen = (labels.filter(usable & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "place")


def in_one_task(rows: DataFrame, fit: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``fit`` over a bounded sample in one task; rows come in the order of ``place`` and ``doc_id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield fit(pa.Table.from_batches(held).sort_by([("place", "ascending"), ("doc_id", "ascending")]))

    return rows.repartition(1).mapInArrow(run, schema)
