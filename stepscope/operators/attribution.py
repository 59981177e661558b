"""Source attribution: from device symbols to the host operators and Python frames that launched them.

Sources are found inside a mapping trace and carried to another trace by symbol only. Mapping durations
never enter the timed rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import UNINFORMATIVE_FRAMES
from ..functions.expressions import is_runtime, normalized_symbol
from ..functions.layout import latest_before
from ..functions.sweep import enclosing_least
from ..session import materialize
from ..sources.rules import RuleSet
from .classify import classify_names, sql_text
from .events import complete

THREAD = "concat_ws('/', coalesce(pid, 'None'), coalesce(tid, 'None'))"
GRAPH_LAUNCH = "(contains(lower({n}), 'graph') AND (contains(lower({n}), 'launch') OR contains(lower({n}), 'replay')))"
INSTANT = "ts_ns + least(dur_ns DIV 2, 500L)"
SITE = ["cpu_op", "python_location", "host_pid", "host_tid"]


def classified_kernels(device: DataFrame, rules: RuleSet) -> DataFrame:
    """Device events whose name has a category; names are classified once each."""
    named = classify_names(device, rules, ["category"]).filter("detail.category IS NOT NULL").select("name")
    return device.join(named, "name", "left_semi")


def innermost_ops(hosts: DataFrame, cpu_ops: DataFrame) -> DataFrame:
    """Shortest CPU operator around each host event's start; equally short ones are all kept.

    Only operators of the shortest length meet the host event, in bins of that length.
    """
    points = hosts.selectExpr("trace_id", f"{THREAD} AS thread", "id AS host_id", "ts_ns AS at")
    spans = complete(cpu_ops).selectExpr("trace_id", f"{THREAD} AS thread", "id AS op_id", "name AS op_name", "dur_ns AS op_dur",
                                         "ts_ns AS start", "ts_ns + dur_ns AS end")
    shortest = enclosing_least(points, spans, ["trace_id", "thread"], "host_id", "at", "start", "end", ["op_dur"]).selectExpr(
        "trace_id", "thread", "host_id", "at", "lanes[0].least[0].op_dur AS op_dur")
    asked = shortest.selectExpr("*", "explode(array(at - pmod(at, op_dur), at - pmod(at, op_dur) - op_dur)) AS _bin")
    return asked.join(spans.selectExpr("*", "start - pmod(start, op_dur) AS _bin"), ["trace_id", "thread", "op_dur", "_bin"]).filter(
        "start <= at AND at < end").select("trace_id", "host_id", "op_id", "op_name", "op_dur")


def host_frames(hosts: DataFrame, frames: DataFrame) -> DataFrame:
    """Innermost informative Python frame around each host event, and up to eight frames by duration."""
    points = hosts.selectExpr("trace_id", f"{THREAD} AS thread", "id AS host_id", f"{INSTANT} AS at")
    dull = " OR ".join(f"contains(name, {sql_text(w)})" for w in UNINFORMATIVE_FRAMES)
    spans = complete(frames).selectExpr("trace_id", f"{THREAD} AS thread", "id AS frame_id", "name AS frame", "dur_ns AS frame_dur",
                                        "ts_ns AS start", "ts_ns + dur_ns AS end", f"({dull}) AS dull")
    around = enclosing_least(points, spans, ["trace_id", "thread"], "host_id", "at", "start", "end", ["frame_dur", "frame_id"], ["frame"], ["dull"], 8)
    return around.selectExpr(
        "trace_id", "host_id",
        "array_min(transform(lanes, x -> struct(x.dull, x.least[0].frame_dur, x.least[0].frame_id, x.least[0].frame))).frame AS python_location",
        "aggregate(lanes, 0L, (n, x) -> n + x.n) AS frame_count",
        "transform(slice(array_sort(flatten(transform(lanes, x -> x.least))), 1, 8), x -> x.frame) AS python_stack")


def latest_launches(kernels: DataFrame, launches: DataFrame) -> DataFrame:
    """Latest launch of a kernel's correlation id on each host thread, not after the kernel.

    Kernels meet the host threads that use their id, not all launches of the id.
    """
    calls = launches.filter("correlation IS NOT NULL").selectExpr(
        "trace_id", "correlation", f"{THREAD} AS thread", "ts_ns", "id", "name", "dur_ns", "external_id", "pid", "tid")
    threads = calls.select("trace_id", "correlation", "thread").distinct()
    probes = kernels.filter("correlation IS NOT NULL").selectExpr(
        "trace_id", "correlation", "ts_ns", "id AS kernel_id", "name AS symbol", "external_id AS kernel_ext").join(
        threads, ["trace_id", "correlation"])
    value = F.struct("id", "name", "ts_ns", "dur_ns", "external_id", "pid", "tid")
    found = latest_before(probes, calls, ["trace_id", "correlation", "thread"], "ts_ns", value, -F.col("id"), "launch")
    return found.filter("launch IS NOT NULL").selectExpr(
        "trace_id", "kernel_id", "symbol", "kernel_ext", "ts_ns AS kernel_ts", "thread", "launch.id AS launch_id",
        "launch.name AS launch_name", "launch.ts_ns AS launch_ts", "launch.dur_ns AS launch_dur",
        "launch.external_id AS launch_ext", "launch.pid AS pid", "launch.tid AS tid",
        f"{GRAPH_LAUNCH.format(n='launch.name')} AS is_graph")


def _sites_around(probes: DataFrame, spans: DataFrame, site: list[str], rank: list[str]) -> DataFrame:
    """Sites of the CPU operators with a given external id around a launch on its thread, each with its least ``rank``."""
    return enclosing_least(probes, spans.filter("ext IS NOT NULL"), ["trace_id", "thread", "ext"], "launch_id", "at", "start", "end", rank, (), site)


def attribution(slices: DataFrame, kernels: DataFrame) -> DataFrame:
    """(kernel, site, basis) rows by the first tier that finds a host, and one row for each kernel without.

    Tier 0: the kernel's external id names CPU operators (around its launch where one is linked). Else
    per launch, tier 1: the launch's external id; tier 2: the innermost CPU operator around the launch;
    tier 3: the launch alone. Graph launches are no evidence of the original operator.

    Many operators around a launch share few sites, so launches meet sites, not operators: a site has one row per kernel and launch
    whatever the number of operators there, with the least of their stacks.
    """
    kernels = materialize(kernels.select("trace_id", "id", "name", "correlation", "external_id", "ts_ns"))
    finished = complete(slices)
    cpu_ops = finished.filter("category = 'cpu_op'")
    wanted = kernels.select("trace_id", "correlation").filter("correlation IS NOT NULL").distinct()
    launches = finished.filter(is_runtime(F.col("category"))).join(wanted, ["trace_id", "correlation"], "left_semi")
    linked = materialize(latest_launches(kernels, launches))
    per_kernel = linked.groupBy("trace_id", "kernel_id").agg(
        F.expr("count(1) AS n_launch"), F.expr("count_if(is_graph) AS n_graph"))
    subjects = materialize(
        kernels.selectExpr("trace_id", "id AS kernel_id", "name AS symbol", "external_id AS kernel_ext", "ts_ns AS kernel_ts")
        .join(per_kernel, ["trace_id", "kernel_id"], "left").selectExpr(
            "trace_id", "kernel_id", "symbol", "kernel_ext", "kernel_ts", "coalesce(n_launch, 0L) AS n_launch",
            "coalesce(n_graph, 0L) AS n_graph"))
    direct = linked.filter("NOT is_graph")
    calls = materialize(direct.select("trace_id", "thread", "launch_id", "launch_name", "launch_ts", "launch_dur", "launch_ext",
                                      "pid", "tid").distinct())
    asked = materialize(direct.filter("kernel_ext IS NOT NULL").selectExpr("trace_id", "thread", "kernel_ext AS ext", "launch_id",
                                                                           "launch_ts AS at").distinct())
    unlinked = subjects.filter("n_launch = 0 AND kernel_ext IS NOT NULL")
    asked_ext = asked.select("trace_id", "ext").unionByName(unlinked.selectExpr("trace_id", "kernel_ext AS ext")).distinct()

    # Operators and launches with their frame, stack and thread. Graph launches among the operators name no site.
    frames = finished.filter("category = 'python_function'")
    ops = cpu_ops.selectExpr("trace_id", "id AS host_id", "pid", "tid", f"{THREAD} AS thread", "external_id AS ext", "ts_ns", "dur_ns", "name AS cpu_op",
                             _call_stack(slices), f"coalesce({GRAPH_LAUNCH.format(n='name')}, TRUE) AS hidden", "ts_ns AS start", "ts_ns + dur_ns AS end")
    asked_ops = ops.join(asked_ext, ["trace_id", "ext"], "left_semi")
    place = ["trace_id", "pid", "tid", "id", "ts_ns", "dur_ns"]
    site_hosts = materialize(asked_ops.filter("NOT hidden").withColumnRenamed("host_id", "id").select(*place).unionByName(
        calls.selectExpr("trace_id", "pid", "tid", "launch_id AS id", "launch_ts AS ts_ns", "launch_dur AS dur_ns")))
    located = materialize(host_frames(site_hosts, frames).drop("frame_count"))
    op_sites = materialize(_site_columns(asked_ops.join(located, ["trace_id", "host_id"], "left"), "thread", "ext", "hidden", "ts_ns", "start", "end"))

    # Tier 0 around a linked launch, per distinct (launch, external id).
    named = materialize(_sites_around(asked, op_sites, [*SITE, "hidden"], ["python_stack"]).selectExpr("trace_id", "launch_id", "ext AS kernel_ext", "lanes"))
    tier0 = materialize(direct.select("trace_id", "kernel_id", "launch_id", "kernel_ext").join(named, ["trace_id", "launch_id", "kernel_ext"]).select(
        "trace_id", "kernel_id", "lanes"))
    by_ext = tier0.selectExpr("trace_id", "kernel_id", "inline(lanes)").filter("NOT hidden").selectExpr(
        "trace_id", "kernel_id", *SITE, "least[0].python_stack AS python_stack", "'external-id' AS basis")

    # Tiers 1 to 3, per distinct launch.
    name = ["cpu_op", "call_stack", "hidden"]
    tier1 = materialize(_sites_around(calls.filter("launch_ext IS NOT NULL").selectExpr(
        "trace_id", "thread", "launch_ext AS ext", "launch_id", "launch_ts AS at"), ops, name, ["start"]).selectExpr(
        "trace_id", "launch_id", "lanes", "'correlation+launch-external-id' AS basis"))
    rest = calls.join(tier1, ["trace_id", "launch_id"], "left_anti")
    inner = enclosing_least(rest.selectExpr("trace_id", "thread", "launch_id", "launch_ts AS at"), ops.withColumnRenamed("dur_ns", "op_dur"),
                            ["trace_id", "thread"], "launch_id", "at", "start", "end", ["op_dur"], (), name)
    tier2 = materialize(inner.selectExpr("*", "array_min(transform(lanes, x -> x.least[0].op_dur)) AS shortest").selectExpr(
        "trace_id", "launch_id", "filter(lanes, x -> x.least[0].op_dur = shortest) AS lanes", "'correlation+host-thread-enclosure' AS basis"))
    tier3 = rest.join(tier2, ["trace_id", "launch_id"], "left_anti").selectExpr(
        "trace_id", "launch_id", "array(named_struct('cpu_op', CAST(NULL AS STRING), 'call_stack', CAST(NULL AS STRING), 'hidden', FALSE)) AS names",
        "'correlation+python-frame' AS basis")
    names = "transform(lanes, x -> named_struct('cpu_op', x.cpu_op, 'call_stack', x.call_stack, 'hidden', x.hidden)) AS names"
    by_launch = tier1.selectExpr("trace_id", "launch_id", names, "basis").unionByName(
        tier2.selectExpr("trace_id", "launch_id", names, "basis")).unionByName(tier3)
    launch_sites = materialize(_site_columns(
        by_launch.selectExpr("trace_id", "launch_id", "basis", "inline(names)").filter("NOT hidden")
        .join(calls.select("trace_id", "launch_id", "pid", "tid"), ["trace_id", "launch_id"])
        .join(located.withColumnRenamed("host_id", "launch_id"), ["trace_id", "launch_id"], "left"), "launch_id", "basis")
        .groupBy("trace_id", "launch_id").agg(F.expr(f"collect_list(struct({', '.join(SITE)}, python_stack, basis)) AS sites")))
    later = direct.select("trace_id", "kernel_id", "launch_id").join(tier0.select("trace_id", "kernel_id"), ["trace_id", "kernel_id"], "left_anti").join(
        launch_sites, ["trace_id", "launch_id"]).selectExpr("trace_id", "kernel_id", "inline(sites)")

    # Tier 0 without a launch: an operator site counts from its first occurrence with that external id.
    early = op_sites.filter("NOT hidden").groupBy("trace_id", F.col("ext").alias("kernel_ext"), *SITE).agg(
        F.expr("min(ts_ns) AS since"), F.expr("min_by(python_stack, ts_ns) AS python_stack"))
    unlaunched = unlinked.join(early, ["trace_id", "kernel_ext"]).filter("since <= kernel_ts").select(
        "trace_id", "kernel_id", *SITE, "python_stack", F.lit("external-id").alias("basis"))
    sites = by_ext.unionByName(later).unionByName(unlaunched).filter("cpu_op IS NOT NULL OR python_location IS NOT NULL")

    return subjects.join(sites, ["trace_id", "kernel_id"], "left").selectExpr(
        "trace_id", "kernel_id", "symbol", *SITE, "python_stack", "basis",
        "CASE WHEN n_launch > 0 AND n_graph = n_launch THEN 'graph-launch-only' WHEN basis IS NULL THEN 'missing-host-link' "
        "WHEN n_graph > 0 THEN 'mixed-graph-and-kernel-launch-links' END AS reason")


def _call_stack(slices: DataFrame) -> str:
    return "call_stack" if "call_stack" in slices.columns else "CAST(NULL AS STRING) AS call_stack"


def _site_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.selectExpr("trace_id", *extra, "cpu_op", "coalesce(python_location, call_stack) AS python_location",
                         "coalesce(pid, 'None') AS host_pid", "coalesce(tid, 'None') AS host_tid",
                         "coalesce(python_stack, CAST(array() AS array<string>)) AS python_stack")


def symbol_sites(attributed: DataFrame) -> DataFrame:
    """Sites of each symbol with the number of kernels seen there and the ways they were found."""
    seen = attributed.filter("basis IS NOT NULL").groupBy("trace_id", "symbol", *SITE, "kernel_id").agg(
        F.expr("collect_set(basis) AS bases"), F.expr("min(python_stack) AS python_stack"))
    return seen.groupBy("trace_id", "symbol", *SITE).agg(
        F.expr("count(1) AS observation_count"), F.expr("array_sort(array_distinct(flatten(collect_set(bases)))) AS attribution_basis"),
        F.expr("min(python_stack) AS python_stack"))


def symbol_links(attributed: DataFrame) -> DataFrame:
    """Per symbol: kernels without a source, why, and whether launch links were mixed."""
    per_kernel = attributed.groupBy("trace_id", "symbol", "kernel_id").agg(
        F.expr("bool_or(basis IS NOT NULL) AS found"), F.expr("max(reason) AS reason"))
    return per_kernel.groupBy("trace_id", "symbol").agg(
        F.expr("count(1) AS kernel_count"), F.expr("count_if(NOT found) AS unresolved_count"),
        F.expr("array_sort(collect_set(IF(found, NULL, reason))) AS unresolved_reasons"),
        F.expr("array_sort(collect_set(IF(found, reason, NULL))) AS link_ambiguities"))


def normalized_symbols(names: DataFrame) -> DataFrame:
    """Distinct kernel names with their normal form."""
    return names.select("name").distinct().withColumn("normalized", normalized_symbol(F.col("name")))


def attach_sources(rows: DataFrame, sites: DataFrame, links: DataFrame, differing: DataFrame | None = None) -> DataFrame:
    """Source status of timed symbols ``(trace_id, kernel_name, …)`` from a mapping of the same pair.

    An exact name wins over names that agree after normalisation. ``differing`` lists the pairs whose
    run configurations differ.
    """
    mapping = links.withColumn("_norm", normalized_symbol(F.col("symbol")))
    exact = rows.select("trace_id", "kernel_name").join(
        mapping.select("trace_id", F.col("symbol").alias("kernel_name")), ["trace_id", "kernel_name"], "left_semi") \
        .selectExpr("trace_id", "kernel_name", "kernel_name AS symbol", "'name:exact' AS match_basis")
    near = rows.select("trace_id", "kernel_name").join(exact, ["trace_id", "kernel_name"], "left_anti") \
        .withColumn("_norm", normalized_symbol(F.col("kernel_name"))) \
        .join(mapping.select("trace_id", "_norm", "symbol"), ["trace_id", "_norm"]) \
        .selectExpr("trace_id", "kernel_name", "symbol", "'name:normalized' AS match_basis")
    per_symbol = sites.groupBy("trace_id", "symbol").agg(
        F.expr("count(1) AS n_sites"), F.expr("count_if(cpu_op IS NULL OR python_location IS NULL) AS n_part"))
    matched = exact.unionByName(near).join(links, ["trace_id", "symbol"]).join(per_symbol, ["trace_id", "symbol"], "left") \
        .groupBy("trace_id", "kernel_name").agg(
        F.expr("any_value(match_basis) AS match_basis"), F.expr("count(1) AS n_symbols"), F.expr("sum(coalesce(n_sites, 0)) AS n_sources"),
        F.expr("sum(coalesce(n_part, 0)) AS n_part"), F.expr("sum(unresolved_count) AS n_unresolved"),
        F.expr("array_sort(array_distinct(flatten(collect_set(unresolved_reasons)))) AS unresolved_reasons"),
        F.expr("array_sort(array_distinct(flatten(collect_set(link_ambiguities)))) AS link_ambiguities"))
    joined = rows.join(matched, ["trace_id", "kernel_name"], "left")
    if differing is None:
        joined = joined.withColumn("_differs", F.lit(False))
    else:
        flagged = differing.select("trace_id").distinct().withColumn("_flag", F.lit(True))
        joined = joined.join(flagged, "trace_id", "left").withColumn("_differs", F.coalesce("_flag", F.lit(False))).drop("_flag")
    doubts = joined.selectExpr(
        *[f"`{c}`" for c in rows.columns], "coalesce(match_basis, 'none') AS match_basis", "coalesce(n_sources, 0L) AS source_count",
        "coalesce(n_unresolved, 0L) AS mapping_unresolved_count", "n_symbols", "n_part", "unresolved_reasons",
        "concat(coalesce(link_ambiguities, CAST(array() AS array<string>)), filter(array("
        "IF(n_symbols > 1, 'multiple-mapping-symbols', NULL), IF(n_sources > 1, 'multiple-source-sites', NULL), "
        "IF(n_unresolved > 0 AND n_sources > 0, 'mapping-occurrences-without-source', NULL), "
        "IF(_differs, 'pair-config-differences', NULL)), x -> x IS NOT NULL)) AS _doubts")
    return doubts.selectExpr(
        *[f"`{c}`" for c in rows.columns], "match_basis", "source_count", "mapping_unresolved_count",
        "CASE WHEN source_count = 0 THEN 'unresolved' WHEN size(_doubts) > 0 THEN 'ambiguous' "
        "WHEN n_part > 0 THEN 'partial' ELSE 'mapped' END AS source_status",
        "CASE WHEN match_basis = 'none' THEN concat(_doubts, array('no-symbol-match')) "
        "WHEN source_count = 0 THEN concat(_doubts, unresolved_reasons) WHEN size(_doubts) > 0 THEN _doubts "
        "WHEN n_part > 0 THEN array('incomplete-host-source') ELSE _doubts END AS ambiguity_reasons")


def source_summary(attached: DataFrame) -> DataFrame:
    """Symbols and time per pair and source status."""
    return attached.groupBy("trace_id", "source_status").agg(
        F.expr("count(1) AS symbol_count"), F.expr("sum(total_duration_us) AS total_duration_us"))


def config_diff(mapping: DataFrame, formal: DataFrame) -> DataFrame:
    """Fields ``(trace_id, field, value)`` that differ between two run configurations, graph flag aside."""
    left = mapping.filter("field <> 'graph_enabled'").selectExpr("trace_id", "field", "value AS mapping", "TRUE AS in_mapping")
    right = formal.filter("field <> 'graph_enabled'").selectExpr("trace_id", "field", "value AS formal", "TRUE AS in_formal")
    both = left.join(right, ["trace_id", "field"], "full")
    return both.filter("in_mapping IS NULL OR in_formal IS NULL OR NOT (mapping <=> formal)").select(
        "trace_id", "field", "mapping", "formal")


def config_flags(mapping: DataFrame, formal: DataFrame) -> DataFrame:
    """Whether a pair declares graph capture off for mapping and on for the timed run."""
    both = mapping.selectExpr("trace_id", "field", "value", "'mapping' AS side").unionByName(
        formal.selectExpr("trace_id", "field", "value", "'formal' AS side"))
    return both.groupBy("trace_id").agg(
        F.expr("coalesce(bool_or(side = 'mapping' AND field = 'graph_enabled' AND lower(value) = 'false'), FALSE) AS mapping_off"),
        F.expr("coalesce(bool_or(side = 'formal' AND field = 'graph_enabled' AND lower(value) = 'true'), FALSE) AS formal_on")) \
        .withColumn("error_code", F.expr("IF(mapping_off AND formal_on, NULL, 'graph_flags_not_declared')"))


def graph_evidence(slices: DataFrame, kernels: DataFrame) -> DataFrame:
    """Graph launches whose correlation id occurs on selected kernels, counted by name."""
    wanted = kernels.select("trace_id", "correlation").filter("correlation IS NOT NULL").distinct()
    launches = complete(slices).filter(is_runtime(F.col("category"))).filter(GRAPH_LAUNCH.format(n="name"))
    return launches.join(wanted, ["trace_id", "correlation"], "left_semi").groupBy("trace_id", "name").agg(
        F.expr("count(1) AS launch_count"))
