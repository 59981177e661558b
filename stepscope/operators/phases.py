"""Prefill and decode phases from forward steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import ordered_index

GAP_NS = 100_000_000


def forward_slices(slices: DataFrame) -> DataFrame:
    """Finished slices named like a model forward step (letter case as written)."""
    return slices.filter("(contains(name, 'model_forward') OR contains(name, 'ModelForward')) AND dur_ns > 0")


def forward_slices_or_stages(slices: DataFrame) -> DataFrame:
    """Slices named like a forward step, or, in traces without any, like a prefill or decode stage."""
    named = slices.withColumn("_forward", F.expr("name ILIKE '%forward%'")).filter(
        "_forward OR name ILIKE '%prefill%' OR name ILIKE '%decode%'")
    with_forward = named.filter("_forward").select("trace_id").distinct()
    first = named.filter("_forward")
    fallback = named.filter("NOT _forward").join(with_forward, "trace_id", "left_anti")
    return first.unionByName(fallback).drop("_forward")


def indexed_steps(forwards: DataFrame, gap_ns: int = GAP_NS) -> DataFrame:
    """Forward steps in order, with the gap around each and the index of the last large gap of the trace."""
    ordered = ordered_index(forwards.select("trace_id", "id", "ts_ns", "dur_ns"), ["trace_id"], "ts_ns", ["id"], ["ts_ns", "dur_ns"])
    gaps = ordered.selectExpr(
        "trace_id", "id", "ts_ns", "dur_ns", "idx", "idx_count", "next_row.ts_ns - (ts_ns + dur_ns) AS gap_after_ns",
        "ts_ns - (prev_row.ts_ns + prev_row.dur_ns) AS gap_before_ns")
    split = gaps.groupBy("trace_id").agg(F.expr(f"max(IF(gap_after_ns > {gap_ns}L, idx, NULL)) AS split"))
    return gaps.join(split, "trace_id")


def step_labels(forwards: DataFrame, gap_ns: int = GAP_NS, shown_gap_ns: int = 50_000_000) -> DataFrame:
    """Step labels around the last large gap; short gaps are not shown."""
    return indexed_steps(forwards, gap_ns).selectExpr(
        "trace_id", "id", "idx AS step", "CASE WHEN split IS NULL AND idx = 0 THEN 'prefill' "
        "WHEN split IS NULL THEN concat('decode-', idx) WHEN idx <= split THEN concat('slow-', idx) "
        "ELSE concat('fast-', idx - split - 1) END AS label", "dur_ns", "gap_after_ns",
        f"IF(gap_before_ns > {shown_gap_ns}L, gap_before_ns / 1000000D, NULL) AS shown_gap_ms")


def phase_windows(forwards: DataFrame, starts: DataFrame, gap_ns: int = GAP_NS, decode_index: int = 2,
                  prefill_at_trace_start: bool = False) -> DataFrame:
    """Prefill and decode window per trace.

    The last large gap separates slow steps from the fast cadence. ``decode_index`` counts fast steps
    from 0. Without a large gap the first step is the prefill, from its own start or, on request, from
    the trace start. ``starts`` holds ``trace_start_ns``.
    """
    steps = indexed_steps(forwards, gap_ns).withColumn("fast_idx", F.expr("idx - coalesce(split, -1) - 1"))
    n = decode_index
    end = "ts_ns + dur_ns"
    points = steps.groupBy("trace_id").agg(
        F.expr("any_value(split) AS split"), F.expr("max(idx_count) AS steps"), F.expr("max(fast_idx) + 1 AS fast"),
        F.expr("min(IF(fast_idx = 0, ts_ns, NULL)) AS first_fast"), F.expr("min(IF(idx = 0, ts_ns, NULL)) AS first_ts"),
        F.expr(f"min(IF(idx = 0, {end}, NULL)) AS first_end"), F.expr(f"min(IF(fast_idx = {n}, ts_ns, NULL)) AS nth_ts"),
        F.expr(f"min(IF(fast_idx = {n}, {end}, NULL)) AS nth_end"), F.expr(f"min(IF(fast_idx = {n + 1}, ts_ns, NULL)) AS after_ts"),
        F.expr("min(IF(idx = idx_count - 1, ts_ns, NULL)) AS last_ts"), F.expr(f"min(IF(idx = idx_count - 1, {end}, NULL)) AS last_end"))
    early = "trace_start_ns" if prefill_at_trace_start else "first_ts"
    row = "named_struct('stage', '{stage}', 'start_ns', {a}, 'end_ns', {b})"
    prefill = row.format(stage="prefill", a=f"IF(split IS NULL, {early}, trace_start_ns)", b="IF(split IS NULL, first_end, first_fast)")
    decode = row.format(
        stage="decode",
        a=f"IF(split IS NULL, IF(steps > {n}, nth_ts, last_ts), IF({n} < fast - 1, nth_ts, last_ts))",
        b=f"IF(split IS NULL, IF(steps > {n}, nth_end, last_end), IF({n} < fast - 1, after_ts, last_end))")
    return points.join(starts, "trace_id").selectExpr(
        "trace_id", "steps AS step_count", "IF(split IS NULL, NULL, fast) AS fast_count",
        "IF(split IS NULL AND steps = 1, 'single_forward', NULL) AS error_code", f"inline(array({prefill}, {decode}))").selectExpr(
        "trace_id", "step_count", "fast_count", "stage AS window_id", "stage", "IF(error_code IS NULL, start_ns, NULL) AS start_ns",
        "IF(error_code IS NULL, end_ns, NULL) AS end_ns", "error_code")
