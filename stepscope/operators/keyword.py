"""Keyword analyser: operator and category statistics, idle time and advice."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ADVICE_THRESHOLDS, BUBBLE_LABEL
from ..functions.expressions import percent, shortened
from ..functions.layout import with_totals
from .classify import keyword_category, sql_text
from .events import window_events


def analysed_events(slices: DataFrame) -> DataFrame:
    """Device events with a name and a duration."""
    kept = window_events(slices).filter("name IS NOT NULL AND name <> '' AND dur_ns <> 0")
    return kept.filter("ph = 'X'") if "ph" in slices.columns else kept


def operator_stats(slices: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Per-operator statistics of each trace. Both shares divide by summed kernel time."""
    totals = analysed_events(slices).groupBy("trace_id", "name").agg(
        F.expr("count(1) AS call_count"), F.expr("sum(dur_ns) AS duration_ns"))
    return with_totals(totals.withColumn("category", keyword_category(rules=rules)), ["trace_id"], trace_ns=F.sum("duration_ns")).select(
        "trace_id", "name", "category", "call_count", (F.col("duration_ns") / F.lit(1000.0)).alias("total_duration_us"),
        (F.col("duration_ns") / F.col("call_count") / F.lit(1000.0)).alias("avg_duration_us"),
        percent(F.col("duration_ns"), F.col("trace_ns")).alias("relative_pct"),
        percent(F.col("duration_ns"), F.col("trace_ns")).alias("absolute_pct"))


def category_stats(slices: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Category rows of each trace with an idle row (when idle) and a total row; shares of kernel time and of the span."""
    names = analysed_events(slices).groupBy("trace_id", "name").agg(
        F.expr("count(1) AS n"), F.expr("sum(dur_ns) AS ns"), F.expr("min(ts_ns) AS lo"), F.expr("max(ts_ns + dur_ns) AS hi"))
    categories = names.withColumn("category", keyword_category(rules=rules)).groupBy("trace_id", "category").agg(
        F.expr("count(1) AS operator_types"), F.expr("sum(n) AS call_count"), F.expr("sum(ns) AS ns"), F.expr("min(lo) AS lo"),
        F.expr("max(hi) AS hi"))
    totals = categories.groupBy("trace_id").agg(
        F.expr("sum(ns) AS kernel_ns"), F.expr("greatest(max(hi) - min(lo) - sum(ns), 0L) AS idle_ns"),
        F.expr("sum(operator_types) AS kinds"), F.expr("sum(call_count) AS calls"))
    extra = totals.selectExpr(
        "trace_id", "kernel_ns", "idle_ns", f"inline(array(named_struct('category', {sql_text(BUBBLE_LABEL)}, 'operator_types', 0L, "
        "'call_count', 0L, 'ns', idle_ns), named_struct('category', 'TOTAL', 'operator_types', kinds, 'call_count', calls, "
        "'ns', kernel_ns + idle_ns)))").filter("category = 'TOTAL' OR idle_ns > 0")
    rows = categories.join(totals, "trace_id").select(*extra.columns).unionByName(extra)
    return rows.selectExpr(
        "trace_id", "category", "operator_types", "call_count", "ns / 1000D AS total_duration_us",
        f"CASE WHEN category = 'TOTAL' THEN 100D WHEN category <> {sql_text(BUBBLE_LABEL)} THEN "
        "try_divide(CAST(ns AS DOUBLE), CAST(kernel_ns AS DOUBLE)) * 100D END AS relative_pct",
        "IF(category = 'TOTAL', 100D, try_divide(CAST(ns AS DOUBLE), CAST(kernel_ns + idle_ns AS DOUBLE)) * 100D) AS absolute_pct")


def advice(stats: DataFrame) -> DataFrame:
    """Categories whose share of kernel time passes its threshold; ``balanced`` where none does."""
    limits = ", ".join(f"'{c}', {t}D" for c, t in ADVICE_THRESHOLDS.items())
    judged = stats.withColumn("threshold_pct", F.expr(f"try_element_at(map({limits}), category)"))
    found = judged.filter("relative_pct > threshold_pct").select("trace_id", "category", "relative_pct", "threshold_pct")
    quiet = stats.select("trace_id").distinct().join(found, "trace_id", "left_anti").selectExpr(
        "trace_id", "'balanced' AS category", "CAST(NULL AS DOUBLE) AS relative_pct", "CAST(NULL AS DOUBLE) AS threshold_pct")
    return found.unionByName(quiet)


def top_operators(stats: DataFrame, keys: list[str], k: int = 10, width: int = 50) -> DataFrame:
    """Longest-running operators per key with a display name; the limit is applied before rows are moved."""
    ranked = stats.withColumn("position", F.expr(
        f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY total_duration_us DESC, name)")).filter(F.col("position") <= k)
    return ranked.select(*keys, "position", "name", shortened(F.col("name"), width).alias("display_name"), "call_count", "total_duration_us")


def event_categories(slices: DataFrame) -> DataFrame:
    """Event counts per trace and category."""
    return slices.groupBy("trace_id", F.coalesce("category", F.lit("")).alias("category")).agg(F.expr("count(1) AS event_count"))
