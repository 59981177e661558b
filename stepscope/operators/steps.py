"""Step annotations, their succession and the device windows between them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CONTEXT_ANNOTATION, DECODE_ANNOTATION, PREFILL_ANNOTATION
from ..functions.layout import bin_width, enclosure_join, ordered_index
from ..session import materialize
from .classify import sql_text
from .links import boundaries_from, event_links, owned_events, scope_runtimes

HOST = "coalesce(concat('thread:', host_thread), concat('track:', track_id))"


def step_pairs(annotations: DataFrame, stage: str = "decode", pattern: str | None = None) -> DataFrame:
    """Numbered annotations of a stage (from 1, by time) with their successor.

    ``error_code`` marks annotations on several host threads, without a successor, or overlapping it.
    """
    regex = pattern or (DECODE_ANNOTATION if stage == "decode" else PREFILL_ANNOTATION)
    matched = annotations.filter(f"category = 'user_annotation' AND name RLIKE {sql_text(regex)}").selectExpr(
        "trace_id", "id", "name", "ts_ns", "dur_ns", "track_id", "host_thread", f"{HOST} AS host")
    hosts = matched.groupBy("trace_id").agg(F.expr("min(host) <> max(host) AS several_hosts"))
    ordered = ordered_index(matched, ["trace_id"], "ts_ns", ["id"], ["id", "ts_ns", "name"])
    return ordered.join(hosts, "trace_id").selectExpr(
        "trace_id", "idx + 1 AS step", "id", "name", "ts_ns", "dur_ns", "track_id", "host_thread",
        "next_row.id AS next_id", "next_row.name AS next_name", "next_row.ts_ns AS next_ts_ns",
        "CASE WHEN several_hosts THEN 'multiple_host_tracks' WHEN next_row IS NULL THEN 'no_next_annotation' "
        "WHEN ts_ns >= next_row.ts_ns OR ts_ns + dur_ns > next_row.ts_ns THEN 'overlapping_annotations' END AS error_code")


def chosen_pairs(annotations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Explicit annotation pairs ``(trace_id, id, next_id)``; they may span stages, not host threads."""
    marks = annotations.filter("category = 'user_annotation'").selectExpr(
        "trace_id", "id", "name", "ts_ns", "dur_ns", "track_id", "host_thread", f"{HOST} AS host")
    after = marks.selectExpr("trace_id", "id AS next_id", "name AS next_name", "ts_ns AS next_ts_ns", "host AS next_host")
    return (pairs.join(marks, ["trace_id", "id"], "left").join(after, ["trace_id", "next_id"], "left").selectExpr(
        "trace_id", "CAST(NULL AS BIGINT) AS step", "id", "name", "ts_ns", "dur_ns", "track_id", "host_thread", "next_id",
        "next_name", "next_ts_ns",
        "CASE WHEN host IS NULL OR next_host IS NULL THEN 'unknown_annotation' WHEN host <> next_host THEN 'multiple_host_tracks' "
        "WHEN ts_ns >= next_ts_ns OR ts_ns + dur_ns > next_ts_ns THEN 'overlapping_annotations' END AS error_code"))


def nth_step(pairs: DataFrame, step: int = 2) -> DataFrame:
    """The numbered step of every trace."""
    if step < 1:
        raise ValueError("steps are numbered from 1")
    return pairs.filter(F.col("step") == step)


def step_windows(pairs: DataFrame, device: DataFrame, runtimes: DataFrame, flows: DataFrame, explicit_scope: bool = False) -> DataFrame:
    """Device window of each step: first owned event of the step to that of its successor.

    ``explicit_scope``: the caller has named the device or its tracks, so events without a device are no doubt.
    """
    successor = pairs.selectExpr("trace_id", "next_id AS id", "next_name AS name", "next_ts_ns AS ts_ns") \
        .filter("id IS NOT NULL")
    scopes = pairs.select("trace_id", "id", "name", "ts_ns", "dur_ns", "track_id", "host_thread")
    missing = successor.join(scopes, ["trace_id", "id"], "left_anti")
    if_missing = missing.selectExpr("trace_id", "id", "name", "ts_ns", "0L AS dur_ns", "CAST(NULL AS BIGINT) AS track_id",
                                    "CAST(NULL AS STRING) AS host_thread")
    all_scopes = scopes.unionByName(if_missing)
    links = materialize(event_links(device, runtimes, flows))
    scope_rt = materialize(scope_runtimes(all_scopes, runtimes))
    owned = materialize(owned_events(links, scope_rt, runtimes, flows))
    bounds = materialize(boundaries_from(all_scopes, links, scope_rt, owned, flows, explicit_scope))
    a = bounds.selectExpr("trace_id", "scope_id AS id", "first_ts_ns AS start_ns", "device AS d1", "error_code AS e1")
    b = bounds.selectExpr("trace_id", "scope_id AS next_id", "first_ts_ns AS end_ns", "device AS d2", "error_code AS e2")
    spans = pairs.join(a, ["trace_id", "id"], "left").join(b, ["trace_id", "next_id"], "left").selectExpr(
        "trace_id", "step", "id AS scope_id", "name AS annotation", "next_id AS next_scope_id", "start_ns", "end_ns",
        "CASE WHEN error_code IS NOT NULL THEN error_code WHEN e1 IS NOT NULL THEN e1 WHEN e2 IS NOT NULL THEN e2 "
        "WHEN start_ns >= end_ns THEN 'reversed_boundaries' WHEN NOT (d1 <=> d2) THEN 'different_devices' END AS error_code")
    return _with_counts(spans, owned, device)


def _with_counts(spans: DataFrame, owned: DataFrame, device: DataFrame) -> DataFrame:
    valid = spans.filter("error_code IS NULL").select("trace_id", "scope_id", "start_ns", "end_ns")
    inside = enclosure_join(device.selectExpr("trace_id", "ts_ns AS at"), valid, ["trace_id"], "at", "start_ns", "end_ns",
                            bin_width(device, "ts_ns")).groupBy("trace_id", "scope_id").agg(F.expr("count(1) AS n_inside"))
    mine = valid.join(owned.select("trace_id", "scope_id", "ts_ns", "dur_ns"), ["trace_id", "scope_id"]).groupBy(
        "trace_id", "scope_id").agg(
        F.expr("count_if(ts_ns >= start_ns AND ts_ns < end_ns) AS n_mine"),
        F.expr("count_if(ts_ns + dur_ns > end_ns) AS n_crossing"))
    joined = spans.join(inside, ["trace_id", "scope_id"], "left").join(mine, ["trace_id", "scope_id"], "left")
    ok = "error_code IS NULL"
    return joined.selectExpr(
        "trace_id", "step", "scope_id", "annotation", "next_scope_id", f"IF({ok}, start_ns, NULL) AS start_ns",
        f"IF({ok}, end_ns, NULL) AS end_ns", f"IF({ok}, (end_ns - start_ns) / 1000D, NULL) AS period_us",
        f"IF({ok}, coalesce(n_mine, 0L), NULL) AS owned_in_window",
        f"IF({ok}, coalesce(n_inside, 0L) - coalesce(n_mine, 0L), NULL) AS not_owned_in_window",
        f"IF({ok}, coalesce(n_crossing, 0L), NULL) AS owned_crossing_end", "error_code")


def boundary_evidence(bounds: DataFrame, windows: DataFrame, origin: DataFrame) -> DataFrame:
    """Evidence rows of step boundaries together with caller-given window edges.

    ``origin`` holds ``trace_start_ns`` per trace; offsets are microseconds from it.
    """
    linked = bounds.join(origin, "trace_id").selectExpr(
        "trace_id", "scope_id AS source_id", "'step' AS side", "annotation", "first_event_name AS event_name",
        "(first_ts_ns - trace_start_ns) / 1000D AS offset_us", "device", "association_basis", "boundary_confidence",
        "ambiguous_event_count", "unlinked_near_boundary", "error_code")
    given = windows.join(origin, "trace_id").selectExpr(
        "trace_id", "window_id AS source_id", "inline(array(named_struct('side', 'start', 'at', start_ns), "
        "named_struct('side', 'end', 'at', end_ns)))", "trace_start_ns").selectExpr(
        "trace_id", "source_id", "side", "CAST(NULL AS STRING) AS annotation", "'用户给定时间' AS event_name",
        "(at - trace_start_ns) / 1000D AS offset_us", "CAST(NULL AS STRING) AS device", "'user-time' AS association_basis",
        "'caller-provided' AS boundary_confidence", "0L AS ambiguous_event_count", "0L AS unlinked_near_boundary",
        "CAST(NULL AS STRING) AS error_code")
    return linked.unionByName(given)


def annotation_work(annotations: DataFrame) -> DataFrame:
    """Prefill and decode request and token counts named by an annotation; mixed when both are present."""
    fields = ["prefill_count", "prefill_tokens", "decode_count", "decode_tokens"]
    parsed = annotations.selectExpr(
        "trace_id", "id", "name",
        *[f"try_cast(nullif(regexp_extract(name, {sql_text(CONTEXT_ANNOTATION)}, {i}), '') AS BIGINT) AS {c}"
          for i, c in enumerate(fields, start=1)])
    return parsed.selectExpr("*", "coalesce(prefill_count > 0 AND decode_count > 0, FALSE) AS mixed")
