"""Classification audit over traces and aggregated tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEVICE_CATEGORIES
from ..sources.rules import RuleSet
from .classify import with_detail


def trace_names(slices: DataFrame) -> DataFrame:
    """Names of device events (category spelled exactly), zero durations included."""
    return slices.filter(F.col("category").isin(DEVICE_CATEGORIES)).groupBy("name").agg(
        F.expr("count(1) AS record_count"), F.expr("sum(dur_ns) / 1000D AS duration_us"))


def audit(inputs: list[DataFrame], rules: RuleSet) -> DataFrame:
    """Calls and time per name with its rule evidence, over inputs ``(name, record_count, duration_us)``."""
    columns = ["name", "record_count", "duration_us"]
    rows = inputs[0].select(*columns)
    for other in inputs[1:]:
        rows = rows.unionByName(other.select(*columns))
    totals = rows.groupBy("name").agg(F.expr("sum(record_count) AS record_count"), F.expr("sum(duration_us) AS duration_us"))
    return with_detail(totals, rules).select("name", "record_count", "duration_us", "detail.*")


def rollup(audited: DataFrame) -> DataFrame:
    """Calls and time per category and rule reason."""
    return audited.groupBy("category", "reason").agg(
        F.expr("sum(record_count) AS record_count"), F.expr("sum(duration_us) AS duration_us"))


def unknown(audited: DataFrame) -> DataFrame:
    """Names no rule matched, or matched with unknown confidence."""
    return audited.filter("matched_pattern IS NULL OR confidence = 'unknown'")


def fail_on_unknown(audited: DataFrame) -> DataFrame:
    """Names as audited; the job fails when any name is unknown."""
    count = unknown(audited).agg(F.count(F.lit(1))).scalar()
    checked = F.assert_true(count == 0, F.lit("unknown kernel names"))
    return audited.filter(checked.isNull())
