"""Time accounting: raw aggregates, category rollups, coverage, idle time and identities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (BUBBLE_LABEL, CATEGORY_ORDER, DENSE_CATEGORIES, EXCLUDED_LABEL, TIME_ROWS, TOTAL_LABEL)
from ..functions.expressions import ns_to_us, percent, round2
from ..functions.layout import bin_width, union_length, with_totals
from ..session import materialize
from ..sources.rules import RuleSet
from .classify import excluded_label, sql_text, with_detail
from .windows import WINDOW_KEYS, carried_in, started_in


def kernel_totals(selected: DataFrame) -> DataFrame:
    """Count and integer time per window and name."""
    return selected.groupBy(*WINDOW_KEYS, "name").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum("dur_ns").alias("duration_ns"),
        F.min("start_ns").alias("start_ns"), F.min("end_ns").alias("end_ns"))


def kernel_aggregate(events: DataFrame, windows: DataFrame) -> DataFrame:
    """The six raw columns per window and kernel name; shares include runtime markers."""
    totals = with_totals(kernel_totals(started_in(events, windows)), WINDOW_KEYS, window_ns=F.sum("duration_ns"))
    return totals.select(
        *WINDOW_KEYS, "name", "record_count", ns_to_us(F.col("duration_ns")).alias("total_duration_us"),
        (F.expr("duration_ns DIV record_count") / F.lit(1000.0)).alias("avg_duration_us"),
        round2(F.col("duration_ns") * F.lit(100.0) / F.nullif(F.col("window_ns"), F.lit(0))).alias("kernel_relative_pct"),
        round2(F.col("duration_ns") * F.lit(100.0) / (F.col("end_ns") - F.col("start_ns"))).alias("window_absolute_pct"))


def classified(totals: DataFrame, rules: RuleSet, *attributes: str) -> DataFrame:
    """Attach classification attributes to per-name totals."""
    return with_detail(totals, rules, attributes or None, count="call_count" if "call_count" in totals.columns else "record_count")


def category_columns(category: str, count: str, duration: str) -> list[Column]:
    """Per-category sums as columns of one aggregate row: kinds, calls and time for each category."""
    return [F.expr(f"CAST(sum(CASE WHEN {category} = {sql_text(label)} THEN {value} ELSE 0 END) AS BIGINT) AS _{tag}{n}")
            for n, label in enumerate(CATEGORY_ORDER) for tag, value in (("k", "1"), ("c", count), ("d", duration))]


def category_structs() -> list[str]:
    """SQL structs that turn the columns of ``category_columns`` back into rows."""
    return [f"named_struct('category_ord', {n}, 'category', {sql_text(label)}, 'kernel_kinds', _k{n}, "
            f"'record_count', _c{n}, 'duration_ns', _d{n})" for n, label in enumerate(CATEGORY_ORDER)]


def unfold_categories(sums: DataFrame, keys: list[str], carry: list[str], moe: str) -> DataFrame:
    """Category rows of a report from one row of sums per window.

    The six dense categories always appear; expert GEMM appears when seen or when expert helpers are;
    the delta-network category appears when seen.
    """
    dense = ", ".join(sql_text(c) for c in DENSE_CATEGORIES)
    return (sums.selectExpr(*keys, *carry, f"{moe} AS _moe", f"inline(array({', '.join(category_structs())}))")
            .filter(f"category IN ({dense}) OR record_count > 0 OR (category = 'group gemm' AND _moe)").drop("_moe"))


def category_summary(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Category rollup per window: kinds, calls, time, share of classified time, share of the window."""
    detail = classified(totals, rules, "category", "semantic_type")
    sums = detail.groupBy(*WINDOW_KEYS).agg(
        *category_columns("detail.category", "record_count", "duration_ns"),
        F.expr("sum(CASE WHEN detail.category IS NOT NULL THEN duration_ns ELSE 0 END) AS busy_ns"),
        F.min("start_ns").alias("start_ns"), F.min("end_ns").alias("end_ns"),
        F.expr("bool_or(startswith(detail.semantic_type, 'moe_')) AS moe"))
    flat = unfold_categories(sums, WINDOW_KEYS, ["busy_ns", "start_ns", "end_ns"], "moe")
    return flat.select(
        *WINDOW_KEYS, "category_ord", "category", "kernel_kinds", "record_count",
        ns_to_us(F.col("duration_ns")).alias("total_duration_us"),
        percent(F.col("duration_ns"), F.col("busy_ns")).alias("kernel_relative_pct"),
        percent(F.col("duration_ns"), F.col("end_ns") - F.col("start_ns")).alias("window_absolute_pct"))


def excluded_markers(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Time of runtime markers per window and report label."""
    return (classified(totals, rules, "category").filter(F.col("detail.category").isNull())
            .groupBy(*WINDOW_KEYS, excluded_label(F.col("name")).alias("category"))
            .agg(F.count(F.lit(1)).alias("kernel_kinds"), F.sum("record_count").alias("record_count"),
                 ns_to_us(F.sum("duration_ns")).alias("total_duration_us")))


def kernel_detail_table(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Per-kernel rows of classified kernels with rule evidence and both shares."""
    kept = classified(totals, rules).filter(F.col("detail.category").isNotNull())
    kept = with_totals(kept, WINDOW_KEYS, busy_ns=F.sum("duration_ns"))
    return kept.select(
        *WINDOW_KEYS, F.col("name").alias("kernel_name"), "detail.category", "detail.reason", "detail.rule_id",
        "detail.semantic_type", "detail.confidence", "detail.evidence", "detail.ambiguity_reasons",
        "detail.category_candidates", F.col("record_count").alias("call_count"),
        ns_to_us(F.col("duration_ns")).alias("total_duration_us"),
        (F.col("duration_ns") / F.col("record_count") / F.lit(1000.0)).alias("avg_duration_us"),
        percent(F.col("duration_ns"), F.col("busy_ns")).alias("relative_pct"),
        percent(F.col("duration_ns"), F.col("end_ns") - F.col("start_ns")).alias("absolute_pct"))


def category_report(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Category sheet of a phase: observed categories, an idle row and a total row."""
    detail = classified(totals, rules, "category").filter("detail.category IS NOT NULL")
    sums = detail.groupBy(*WINDOW_KEYS).agg(
        *category_columns("detail.category", "record_count", "duration_ns"),
        F.count(F.lit(1)).alias("_kinds"), F.sum("record_count").alias("_calls"), F.sum("duration_ns").alias("busy_ns"),
        (F.min("end_ns") - F.min("start_ns")).alias("window_ns"))
    last = len(CATEGORY_ORDER)
    rows = category_structs() + [
        f"named_struct('category_ord', {last}, 'category', {sql_text(BUBBLE_LABEL)}, 'kernel_kinds', 0L, "
        f"'record_count', 0L, 'duration_ns', greatest(window_ns - busy_ns, 0L))",
        f"named_struct('category_ord', {last + 1}, 'category', {sql_text(TOTAL_LABEL)}, 'kernel_kinds', _kinds, "
        f"'record_count', _calls, 'duration_ns', window_ns)"]
    flat = sums.selectExpr(*WINDOW_KEYS, "busy_ns", "window_ns", f"inline(array({', '.join(rows)}))")
    total = F.col("category_ord") == last + 1
    return flat.filter(f"category_ord >= {last} OR record_count > 0").select(
        *WINDOW_KEYS, F.col("category_ord").alias("row_ord"), "category", "kernel_kinds",
        F.col("record_count").alias("call_count"), ns_to_us(F.col("duration_ns")).alias("total_duration_us"),
        F.when(total, F.lit(100.0)).when(F.col("category_ord") < last, percent(F.col("duration_ns"), F.col("busy_ns")))
        .alias("relative_pct"),
        F.when(total, F.lit(100.0)).otherwise(percent(F.col("duration_ns"), F.col("window_ns"))).alias("absolute_pct"))


def touching_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Stored events of each window, those that start in it (``selected``) and those carried into it: the one window join behind totals,
    coverage and idle time."""
    width = bin_width(events, "ts_ns")
    columns = [*WINDOW_KEYS, "start_ns", "end_ns", "ts_ns", "dur_ns", "name"]
    return materialize(started_in(events, windows, width).selectExpr(*columns, "true AS selected").unionByName(
        carried_in(events, windows, width).selectExpr(*columns, "false AS selected")))


def coverage_ns(touching: DataFrame, windows: DataFrame) -> DataFrame:
    """Integer coverage figures per window: summed, covered with and without carry-in."""
    sums = touching.groupBy(*WINDOW_KEYS).agg(
        F.expr("sum(IF(selected, dur_ns, 0L)) AS selected_sum_ns"), F.expr("count_if(selected) AS selected_event_count"),
        F.expr("count_if(NOT selected) AS carry_in_event_count"), F.expr("count_if(dur_ns < 0) AS unfinished_events"))
    clipped = touching.selectExpr(
        *WINDOW_KEYS, "greatest(ts_ns, start_ns) AS s", "least(ts_ns + dur_ns, end_ns) AS e", "selected")
    unions = union_length(clipped, WINDOW_KEYS, "s", "e", "selected")
    joined = windows.join(sums, WINDOW_KEYS, "left").join(unions, WINDOW_KEYS, "left")
    return joined.selectExpr(
        *WINDOW_KEYS, "end_ns - start_ns AS window_ns",
        *[f"coalesce({c}, 0L) AS {c}" for c in (
            "selected_sum_ns", "selected_event_count", "carry_in_event_count", "unfinished_events")],
        "coalesce(union_flagged, 0L) AS selected_covered_ns", "coalesce(union_all, 0L) AS covered_ns")


def window_coverage(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Wall-time coverage per window: union of device intervals clipped to it, carry-in included."""
    c = coverage_ns(touching_events(events, windows), windows)
    return c.select(
        *WINDOW_KEYS, ns_to_us(F.col("window_ns")).alias("window_total_us"),
        ns_to_us(F.col("selected_sum_ns")).alias("selected_duration_sum_us"),
        ns_to_us(F.col("selected_covered_ns")).alias("selected_covered_us"),
        ns_to_us(F.col("covered_ns")).alias("device_covered_us"),
        ns_to_us(F.col("selected_sum_ns") - F.col("selected_covered_ns")).alias("overlap_or_outside_deduction_us"),
        "carry_in_event_count",
        ns_to_us(F.col("covered_ns") - F.col("selected_covered_ns")).alias("carry_in_extra_coverage_us"),
        ns_to_us(F.col("covered_ns") - F.col("selected_sum_ns")).alias("net_boundary_adjustment_us"),
        ns_to_us(F.col("window_ns") - F.col("covered_ns")).alias("bubble_us"),
        percent(F.col("window_ns") - F.col("covered_ns"), F.col("window_ns")).alias("bubble_pct"),
        F.when(F.col("unfinished_events") > 0, "unfinished_events").alias("error_code"))


def window_sums(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Classified and excluded time per window, in nanoseconds."""
    marker = F.col("detail.category").isNull()
    return classified(totals, rules, "category").groupBy(*WINDOW_KEYS).agg(
        F.sum(F.when(marker, 0).otherwise(F.col("duration_ns"))).alias("busy_ns"),
        F.sum(F.when(marker, F.col("duration_ns")).otherwise(0)).alias("excluded_ns"))


def _account_base(touching: DataFrame, windows: DataFrame, rules: RuleSet) -> DataFrame:
    sums = window_sums(kernel_totals(touching.filter("selected")), rules)
    zero = F.lit(0).cast("bigint")
    return coverage_ns(touching, windows).join(sums, WINDOW_KEYS, "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("busy_ns", "excluded_ns")})


def time_account(events: DataFrame, windows: DataFrame, rules: RuleSet) -> DataFrame:
    """Seven rows per window that tie classified, waiting, overlapping, covered and idle time."""
    device = F.col("busy_ns") + F.col("excluded_ns")
    values = [F.col("busy_ns"), F.col("excluded_ns"), device, F.col("covered_ns") - device, F.col("covered_ns"),
              F.col("window_ns") - F.col("covered_ns"), F.col("window_ns")]
    rows = F.array(*[F.struct(F.lit(n).alias("row_ord"), F.lit(label).alias("item"), v.alias("ns"))
                     for n, (label, v) in enumerate(zip(TIME_ROWS, values))])
    flat = _account_base(touching_events(events, windows), windows, rules).select(*WINDOW_KEYS, "window_ns", F.inline(rows))
    return flat.select(*WINDOW_KEYS, "row_ord", "item", ns_to_us(F.col("ns")).alias("total_us"),
                       percent(F.col("ns"), F.col("window_ns")).alias("window_pct"))


def bubble_variants(events: DataFrame, windows: DataFrame, rules: RuleSet) -> DataFrame:
    """Idle time by three definitions: window less classified time, span less summed time, and exact."""
    touching = touching_events(events, windows)
    spans = touching.filter("selected AND dur_ns > 0").groupBy(*WINDOW_KEYS).agg(
        (F.max(F.col("ts_ns") + F.col("dur_ns")) - F.min("ts_ns") - F.sum("dur_ns")).alias("gap_ns"))
    base = _account_base(touching, windows, rules).join(spans, WINDOW_KEYS, "left")
    zero = F.lit(0).cast("bigint")
    return base.select(
        *WINDOW_KEYS, ns_to_us(F.greatest(F.col("window_ns") - F.col("busy_ns"), zero)).alias("window_minus_sum_us"),
        ns_to_us(F.greatest(F.coalesce("gap_ns", zero), zero)).alias("span_minus_sum_us"),
        ns_to_us(F.col("window_ns") - F.col("covered_ns")).alias("window_minus_coverage_us"))


def conservation_checks(events: DataFrame, windows: DataFrame, rules: RuleSet) -> DataFrame:
    """Identities of the time account as rows: both sides in nanoseconds and whether they agree."""
    base = _account_base(touching_events(events, windows), windows, rules)
    raw = F.col("busy_ns") + F.col("excluded_ns")
    checks = [
        ("raw_equals_busy_plus_excluded", F.col("selected_sum_ns"), raw, F.col("selected_sum_ns") == raw),
        ("selected_covered_within_sum", F.col("selected_covered_ns"), F.col("selected_sum_ns"),
         F.col("selected_covered_ns") <= F.col("selected_sum_ns")),
        ("selected_covered_within_covered", F.col("selected_covered_ns"), F.col("covered_ns"),
         F.col("selected_covered_ns") <= F.col("covered_ns")),
        ("covered_within_window", F.col("covered_ns"), F.col("window_ns"), F.col("covered_ns") <= F.col("window_ns")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), a.alias("lhs_ns"), b.alias("rhs_ns"), ok.alias("ok"))
                     for n, a, b, ok in checks])
    return base.select(*WINDOW_KEYS, F.inline(rows))


def reclassified_table(rows: DataFrame, rules: RuleSet, keys: list[str]) -> DataFrame:
    """Category rollup of an aggregated kernel table.

    Time is microseconds as supplied; the window share is the sum of supplied shares, and NULL when any
    row of the table lacks one.
    """
    d = with_detail(rows, rules, ["category"])
    category = F.coalesce(F.col("detail.category"), F.lit(EXCLUDED_LABEL))
    grouped = d.groupBy(*keys, category.alias("category")).agg(
        F.count(F.lit(1)).alias("kernel_kinds"), F.sum("record_count").alias("record_count"),
        F.sum("total_duration_us").alias("total_duration_us"), F.sum("window_absolute_pct").alias("_pct"),
        F.count_if(F.col("window_absolute_pct").isNull()).alias("_missing"))
    both = with_totals(grouped, keys, _lack=F.sum("_missing"),
                       busy_us=F.sum(F.when(F.col("category") != EXCLUDED_LABEL, F.col("total_duration_us"))))
    return both.select(
        *keys, "category", "kernel_kinds", "record_count", "total_duration_us",
        F.when(F.col("category") != EXCLUDED_LABEL, percent(F.col("total_duration_us"), F.col("busy_us")))
        .alias("kernel_relative_pct"),
        F.when(F.col("_lack") == 0, F.col("_pct")).alias("window_absolute_pct"))
