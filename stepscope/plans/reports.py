"""End-to-end reports as sets of lazy tables, keyed by trace and window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rank_of
from ..operators import account, attribution, compare, context, events, phases, steps, windows
from ..operators.classify import with_detail
from ..session import materialize
from ..sources.rules import RuleSet


def window_report(slices: DataFrame, flows: DataFrame, chosen: DataFrame, rules: RuleSet, categories: Sequence[str] = (),
                  device_id: str | None = None, track_ids: Sequence[int] = ()) -> dict[str, DataFrame]:
    """Report of explicit windows ``(trace_id, window_id, stage, start_ns, end_ns)``."""
    device = events.window_events(slices, categories, device_id, track_ids)
    runtimes = events.runtimes(slices)
    parts = context.context_parts(slices, device, runtimes, flows, chosen, rules)
    totals = account.kernel_totals(windows.started_in(device, chosen))
    spark = slices.sparkSession
    provenance = ", ".join(f"{_quoted(v)} AS rules_{k}" for k, v in rules.provenance.items())
    stages = context.gdn_stage_summary(parts, chosen)
    return {
        "kernels": account.kernel_aggregate(device, chosen), "detail": account.kernel_detail_table(totals, rules), "parts": parts,
        "summary": context.parts_summary(parts), "excluded": account.excluded_markers(totals, rules),
        "coverage": account.window_coverage(device, chosen), "time_account": account.time_account(device, chosen, rules),
        "checks": account.conservation_checks(device, chosen, rules), "metadata": windows.window_metadata(device, chosen),
        "gdn_stages": stages, "gdn_operators": context.gdn_operators(parts), "manifest": manifest(chosen, stages, rules),
        "downgraded": context.downgraded_gemm(parts), "event_roles": parts.filter("from_context OR startswith(rule_id, 'gdn.context.')"),
        "provenance": spark.range(1).selectExpr(provenance),
    }


def request_report(slices: DataFrame, flows: DataFrame, requests: DataFrame, rules: RuleSet, categories: Sequence[str] = (),
                   device_id: str | None = None, track_ids: Sequence[int] = ()) -> dict[str, DataFrame]:
    """Report of windows asked for as microsecond texts from the trace start, ``(trace_id, window_id, stage, start_us, end_us)``.

    Every request has a row in ``requests``; those with an error are in no other table.
    """
    device = events.window_events(slices, categories, device_id, track_ids)
    checked = materialize(windows.request_metadata(device, windows.relative_windows(requests, windows.trace_bounds(slices))))
    chosen = checked.filter("error_code IS NULL").select("trace_id", "window_id", "stage", "start_ns", "end_ns")
    return {"requests": checked, **window_report(slices, flows, chosen, rules, categories, device_id, track_ids)}


def step_report(slices: DataFrame, flows: DataFrame, rules: RuleSet, stage: str = "decode", step: int = 2, pattern: str | None = None,
                categories: Sequence[str] = (), device_id: str | None = None, track_ids: Sequence[int] = (), host: str | None = None,
                annotation_pairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Report of one step per trace; traces whose step has no valid window stay in ``steps`` with their error.

    ``host`` keeps the annotations of one host thread; ``annotation_pairs`` (trace_id, id, next_id) names the annotations instead.
    """
    device = events.window_events(slices, categories, device_id, track_ids)
    runtimes = events.runtimes(slices)
    marks = slices if host is None else slices.filter(F.col("host_thread") == host)
    pairs = steps.nth_step(steps.step_pairs(marks, stage, pattern), step) if annotation_pairs is None else steps.chosen_pairs(marks, annotation_pairs)
    spans = steps.step_windows(pairs, device, runtimes, flows, explicit_scope=device_id is not None or bool(track_ids))
    chosen = spans.filter("error_code IS NULL").select(
        "trace_id", F.col("scope_id").alias("window_id"), F.lit(stage).alias("stage"), "start_ns", "end_ns", F.col("annotation").alias("anchor"))
    return {"steps": spans, **window_report(slices, flows, chosen, rules, categories, device_id, track_ids)}


def phase_report(slices: DataFrame, rules: RuleSet, decode_index: int = 2, host_operators: bool = True) -> dict[str, DataFrame]:
    """Prefill and decode report per trace from forward steps."""
    if host_operators:
        forwards = phases.forward_slices(slices)
        chosen = slices.filter(events.phase_event(F.col("category"), F.col("name"))).filter("dur_ns > 0")
    else:
        forwards = phases.forward_slices_or_stages(slices)
        chosen = events.device_events(slices)
    found = phases.phase_windows(forwards, windows.trace_bounds(slices), decode_index=decode_index, prefill_at_trace_start=not host_operators)
    spans = found.filter("error_code IS NULL")
    totals = account.kernel_totals(windows.contained_in(chosen, spans))
    return {"phases": found, "steps": phases.step_labels(forwards), "detail": account.kernel_detail_table(totals, rules),
            "categories": account.category_report(totals, rules), "summary": account.category_summary(totals, rules)}


def pair_report(mapping: DataFrame, formal: DataFrame, rules: RuleSet, configs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Timed kernels of formal traces with source sites from mapping traces that share their ``trace_id``."""
    mapping_kernels = attribution.classified_kernels(events.device_events(mapping), rules)
    timed_events = events.device_events(formal)
    timed = timed_events.groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("call_count"), F.sum("dur_ns").alias("duration_ns"))
    rows = account.classified(timed, rules, "category", "rule_id", "confidence").filter("detail.category IS NOT NULL").selectExpr(
        "trace_id", "name AS kernel_name", "detail.category AS category", "detail.rule_id AS rule_id", "call_count",
        "duration_ns / 1000D AS total_duration_us")
    found = attribution.materialize(attribution.attribution(mapping, mapping_kernels))
    tables: dict[str, DataFrame] = {}
    differing = None
    if configs is not None:
        sides = [configs.filter(F.col("side") == side) for side in ("mapping", "formal")]
        differing = attribution.config_diff(*sides)
        tables = {"config_diff": differing, "config_flags": attribution.config_flags(*sides)}
    sites = attribution.symbol_sites(found)
    attached = attribution.attach_sources(rows, sites, attribution.symbol_links(found), differing)
    return {"kernels": attached, "sites": sites, "status": attribution.source_summary(attached),
            "mapping_graphs": attribution.graph_evidence(mapping, mapping_kernels),
            "formal_graphs": attribution.graph_evidence(formal, timed_events), "devices": events.device_identities(timed_events), **tables}


COMPARED = ("summary", "kernels", "excluded", "coverage", "time_account", "gdn_stages", "manifest")


def manifest(chosen: DataFrame, stages: DataFrame, rules: RuleSet) -> DataFrame:
    """What a comparison asks of each window: its stage, whether it is mixed, its rank, the rules and the work its anchor names.

    ``chosen`` may carry ``anchor``, the name of the step annotation, and ``rank``; without, the rank is read from the trace's file name.
    """
    windows_ = chosen if "anchor" in chosen.columns else chosen.withColumn("anchor", F.lit(None).cast("string"))
    windows_ = windows_ if "rank" in chosen.columns else windows_.withColumn("rank", rank_of(F.col("trace_id")).cast("string"))
    named = windows_.select("trace_id", "window_id", "stage", "rank", F.col("window_id").alias("id"), F.coalesce("anchor", F.lit("")).alias("name"))
    work = steps.annotation_work(named).join(named.select("trace_id", "id", "window_id", "stage", "rank"), ["trace_id", "id"])
    return compare.mixed_by_scope(work, stages).select(
        "trace_id", "window_id", "stage", "mixed", "rank", F.lit(rules.sha256).alias("rules_sha256"),
        F.when(F.col("stage") == "prefill", F.col("prefill_tokens")).alias("prefill_tokens"), F.lit(None).cast("bigint").alias("mixed_count"),
        F.lit(None).cast("bigint").alias("mixed_generation_tokens"), F.when(F.col("stage") == "decode", F.col("decode_count")).alias("decode_count"),
        F.when(F.col("stage") == "decode", F.col("decode_tokens")).alias("decode_tokens"))


def report_pair(spark: SparkSession, left: str, right: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The compared tables of two stored reports; a report is not compared with itself."""
    if left.rstrip("/") == right.rstrip("/"):
        raise ValueError("comparison needs two distinct reports")
    return tuple({n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in COMPARED} for folder in (left, right))


def compare_reports(spark: SparkSession, left: str, right: str, pairs: DataFrame, verified: bool, names: tuple[str, str] = ("left", "right")) -> dict[str, DataFrame]:
    """Comparison of windows of two stored reports.

    ``pairs``: ``pair_id, left_trace, left_window, right_trace, right_window``; either side may be NULL. Windows whose report does not
    reconcile are in ``rejected`` and take no part in any ratio: their pairs are blocked as one-sided. ``verified`` says that the
    workloads were found to be equal.
    """
    if not all(n.strip() for n in names) or names[0] == names[1]:
        raise ValueError("sides need distinct names")
    reports = report_pair(spark, left, right)
    checks = [compare.report_checks(r) for r in reports]
    sides: list[dict[str, DataFrame]] = []
    for tag, report, checked in zip(("left", "right"), reports, checks):
        bad = checked.filter("NOT ok").select("trace_id", "window_id").distinct()
        mine = pairs.selectExpr("pair_id", f"{tag}_trace AS trace_id", f"{tag}_window AS window_id").filter("trace_id IS NOT NULL")
        mine = mine.join(bad, ["trace_id", "window_id"], "left_anti")
        sides.append({n: t.join(mine, ["trace_id", "window_id"]) for n, t in report.items()})
    one, other = sides
    blocked = compare.blockers(one["manifest"], other["manifest"], verified)
    stages = [s["gdn_stages"].join(s["manifest"].select("pair_id", "stage"), "pair_id") for s in sides]
    tagged = [c.withColumn("side", F.lit(name)) for c, name in zip(checks, names)]
    return {"checks": tagged[0].unionByName(tagged[1]), "rejected": tagged[0].unionByName(tagged[1]).filter("NOT ok"), "blockers": blocked,
            "categories": compare.compare_categories(one["summary"], other["summary"], blocked, compare.gdn_comparable(*stages)),
            "time": compare.compare_time(one["time_account"], other["time_account"], blocked),
            "gdn": compare.compare_gdn(*stages, blocked, names),
            "rates": compare.context_rate(one["manifest"], other["manifest"], one["time_account"], other["time_account"])}


def table_report(rows: DataFrame, rules: RuleSet) -> dict[str, DataFrame]:
    """Category report of aggregated kernel tables; invalid rows are kept apart with their error."""
    valid = rows.filter("error_code IS NULL")
    return {"summary": account.reclassified_table(valid, rules, ["table_id"]), "rejected": rows.filter("error_code IS NOT NULL"),
            "kernels": with_detail(valid, rules)}


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
