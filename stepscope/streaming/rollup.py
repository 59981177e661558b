"""Category rollup over arriving slices."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import with_detail
from ..operators.events import window_events
from ..sources.rules import RuleSet


def kernel_stream(slices: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Windowed per-name totals of a stream of slices; state is one row per open window and name."""
    timed = window_events(slices).withColumn("at", F.timestamp_micros(F.expr("ts_ns DIV 1000")))
    return timed.withWatermark("at", lateness).groupBy(F.window("at", width).alias("w"), "trace_id", "name").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum("dur_ns").alias("duration_ns"))


def categories(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Category totals of finished windows, for each micro-batch or a drained sink."""
    named = with_detail(totals, rules, ["category"])
    return named.filter("detail.category IS NOT NULL").groupBy("trace_id", F.col("w.start").alias("window_start"), "detail.category").agg(
        F.sum("record_count").alias("record_count"), F.sum("duration_ns").alias("duration_ns"))
