"""Registered queries: every operator on the whole driver tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (account, annotations, attribution, audit, classify, compare, context, events, gemm, keyword, links,
                         occupancy, phases, steps, windows)
from ..session import materialize, shared_path
from ..sources import documents, sinks, tables, traces
from ..sources.rules import RuleSet, load_rules
from . import driver_views as views
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@lru_cache(maxsize=1)
def rules() -> RuleSet:
    return load_rules()


class Trace:
    """The driver's slice view with the selections most queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.slices = views.slices(spark, sf_dir)
        self.device = events.window_events(self.slices)
        self.runtimes = events.runtimes(self.slices)
        self.windows = views.windows(self.slices)

    @property
    def flows(self) -> DataFrame:
        return views.flows(self.slices)

    @property
    def stored_flows(self) -> DataFrame:
        """Flow edges as the stored table they are after ingest, for queries that read them often."""
        return materialize(self.flows)

    @property
    def steps(self) -> DataFrame:
        return views.steps(self.slices)

    @property
    def totals(self) -> DataFrame:
        return account.kernel_totals(windows.started_in(self.device, self.windows))


@query
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account.category_summary(Trace(spark, sf_dir).totals, rules())


@query
def kernel_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return account.kernel_aggregate(t.device, t.windows)


@query
def kernel_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account.kernel_detail_table(Trace(spark, sf_dir).totals, rules())


@query
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account.category_report(Trace(spark, sf_dir).totals, rules())


@query
def excluded_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account.excluded_markers(Trace(spark, sf_dir).totals, rules())


@query
def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return windows.window_metadata(t.device, t.windows)


@query
def carry_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return windows.carried_in(t.device, t.windows).select(
        "trace_id", "window_id", F.col("id").alias("event_id"), "ts_ns", "dur_ns",
        (F.col("ts_ns") + F.col("dur_ns") - F.col("start_ns")).alias("carried_ns"))


@query
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return account.window_coverage(t.device, t.windows)


@query
def time_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return account.time_account(t.device, t.windows, rules())


@query
def bubble_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return account.bubble_variants(t.device, t.windows, rules())


@query
def conservation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return account.conservation_checks(t.device, t.windows, rules())


@query
def link_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    profile = links.link_profile(t.device, t.runtimes, t.flows, {"launch": ("min", "id")})
    return profile.select("trace_id", F.col("id").alias("event_id"), "basis", "candidate_count", "possible_count",
                          F.col("cand_launch").alias("first_candidate"), F.col("poss_launch").alias("first_possible"))


@query
def scope_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return links.scope_runtimes(t.slices.filter("category = 'cpu_op'"), t.runtimes).select(
        "trace_id", "scope_id", "runtime_id", "rt_ts", "on_track")


@query
def owned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    flows = t.stored_flows
    scope_rt = links.scope_runtimes(t.steps, t.runtimes)
    owned = links.owned_events(links.event_links(t.device, t.runtimes, flows), scope_rt, t.runtimes, flows)
    return owned.select("trace_id", "scope_id", F.col("id").alias("event_id"), "ts_ns", "dur_ns", "basis")


@query
def ambiguous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    flows = t.stored_flows
    scope_rt = materialize(links.scope_runtimes(t.steps, t.runtimes))
    profile = materialize(links.event_links(t.device, t.runtimes, flows))
    owned = links.owned_events(profile, scope_rt, t.runtimes, flows)
    return links.uncertain_events(profile, owned, scope_rt, flows).select("trace_id", "scope_id", "uncertain_count")


@query
def step_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return links.scope_boundaries(t.steps, t.device, t.runtimes, t.stored_flows)


@query
def nth_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.step_pairs(Trace(spark, sf_dir).steps, "decode").select(
        "trace_id", "step", "id", "name", "ts_ns", "next_id", "error_code")


@query
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return steps.step_windows(steps.step_pairs(t.steps, "decode"), t.device, t.runtimes, t.stored_flows)


@query
def boundary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    bounds = links.scope_boundaries(t.steps, t.device, t.runtimes, t.stored_flows)
    return steps.boundary_evidence(bounds, t.windows, windows.trace_bounds(t.slices))


@query
def annotation_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.annotation_work(Trace(spark, sf_dir).steps)


class Pair(Trace):
    """Mapping half and timed half of every trace."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.mapping = self.slices.filter(F.col("ts_ns") < views.MAPPING_END_NS)
        self.formal = self.slices.filter(F.col("ts_ns") >= views.MAPPING_END_NS)

    @property
    def mapping_kernels(self) -> DataFrame:
        return attribution.classified_kernels(events.device_events(self.mapping), rules())

    @property
    def formal_rows(self) -> DataFrame:
        timed = events.device_events(self.formal).groupBy("trace_id", "name").agg(
            F.count(F.lit(1)).alias("call_count"), F.sum("dur_ns").alias("duration_ns"))
        return account.classified(timed, rules(), "category").filter("detail.category IS NOT NULL").selectExpr(
            "trace_id", "name AS kernel_name", "detail.category AS category", "call_count", "duration_ns / 1000D AS total_duration_us")

    @property
    def attributed(self) -> DataFrame:
        return attribution.attribution(self.mapping, self.mapping_kernels)

    @property
    def attached(self) -> DataFrame:
        found = materialize(self.attributed)
        return attribution.attach_sources(self.formal_rows, attribution.symbol_sites(found), attribution.symbol_links(found))


class Whole(Pair):
    """Attribution inside one trace: every event of it is mapped."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.mapping = self.slices


@query
def innermost_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return attribution.innermost_ops(t.runtimes, t.slices.filter("category = 'cpu_op'"))


@query
def frame_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return attribution.host_frames(t.runtimes, t.slices.filter("category = 'python_function'"))


@query
def asof_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return attribution.latest_launches(t.device, t.runtimes).select(
        "trace_id", "kernel_id", "thread", "launch_id", "launch_ts", "is_graph")


@query
def attribution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Whole(spark, sf_dir).attributed
    return found.select("trace_id", "kernel_id", "symbol", *attribution.SITE, "basis", "reason").distinct()


@query
def symbol_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.symbol_sites(Whole(spark, sf_dir).attributed).drop("python_stack")


@query
def symbol_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.symbol_links(Whole(spark, sf_dir).attributed)


@query
def cross_trace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pair(spark, sf_dir).attached


@query
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.source_summary(Pair(spark, sf_dir).attached).withColumn(
        "total_duration_us", F.round("total_duration_us", 3))


@query
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Whole(spark, sf_dir)
    return attribution.graph_evidence(p.mapping, p.mapping_kernels)


@query
def normalized_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names stretch the symbol list, so the work grows with the data."""
    parts = views.table(spark, sf_dir, "part").selectExpr(
        "concat(IF(p_partkey % 2 = 0, 'void ', ''), replace(p_name, ' ', '_'), '<', p_size, '>', '(', p_type, '(', p_brand, ')', ') ') AS name")
    return attribution.normalized_symbols(Trace(spark, sf_dir).slices.select("name").unionByName(parts))


@query
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as run settings: a pair per order, a field per line number."""
    lines = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_linestatus").alias("status"), F.max(F.col("l_quantity").cast("int")).alias("quantity"),
        F.min("l_suppkey").alias("supplier"))
    setting = "l_orderkey AS trace_id, concat('line', l_linenumber) AS field".split(", ", 1)
    left = lines.selectExpr(*setting, "CAST(quantity AS STRING) AS value").filter("NOT endswith(value, '3')")
    right = lines.selectExpr(*setting, "CAST(quantity + IF(supplier % 5 = 0, 1, 0) AS STRING) AS value").filter("NOT endswith(value, '7')")
    return attribution.config_diff(left, right)


class Context(Trace):
    """Stored flow edges and the profiles context roles are read from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.edges = self.stored_flows

    @property
    def experts(self) -> DataFrame:
        return context.expert_profile(self.device, self.runtimes, self.edges,
                                      context.expert_launches(self.slices, self.runtimes, rules()))

    @property
    def roles(self) -> DataFrame:
        return context.gdn_profile(self.slices, self.device, self.runtimes, self.edges)

    @cached_property
    def parts(self) -> DataFrame:
        """Stored once, however many tables of a query are built from them."""
        return context.context_parts(self.slices, self.device, self.runtimes, self.edges, self.windows, rules())

    @property
    def anchored_windows(self) -> DataFrame:
        anchors = self.steps.selectExpr("trace_id", f"(ts_ns - {views.ORIGIN_NS}) DIV {views.SLOT_NS} AS window_id", "name AS anchor")
        return self.windows.join(anchors, ["trace_id", "window_id"], "left")


@query
def expert_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    return context.expert_launches(t.slices, t.runtimes, rules())


@query
def expert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark, sf_dir).experts.selectExpr(
        "trace_id", "id AS event_id", "basis", "expert_basis", "expert_rule", "touches_expert")


@query
def moe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    return context.moe_split(materialize(c.experts), c.windows, rules())


@query
def launch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    return context.launch_conflicts(materialize(c.experts), c.runtimes, c.edges)


@query
def gdn_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark, sf_dir).roles.selectExpr("trace_id", "id AS event_id", "basis", "role", "replayable")


@query
def gdn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    return context.gdn_split(materialize(c.roles), c.windows, c.slices, rules())


@query
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.parts_summary(Context(spark, sf_dir).parts)


@query
def downgraded_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.downgraded_gemm(Context(spark, sf_dir).parts)


@query
def gdn_stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    return context.gdn_stage_summary(c.parts, c.anchored_windows)


@query
def gdn_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.gdn_operators(Context(spark, sf_dir).parts)


PHASE_GAP_NS = 10 * 24 * views.HOUR_NS


@query
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    forwards = phases.forward_slices(views.forwards(spark, sf_dir))
    return phases.step_labels(forwards, PHASE_GAP_NS, 2 * 24 * views.HOUR_NS)


@query
def phase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    forwards = phases.forward_slices_or_stages(views.forwards(spark, sf_dir))
    return phases.phase_windows(forwards, windows.trace_bounds(forwards), PHASE_GAP_NS)


@query
def phase_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole events inside each window, host operators named like device work included."""
    t = Trace(spark, sf_dir)
    chosen = t.slices.filter(events.phase_event(F.col("category"), F.col("name"))).filter("dur_ns > 0")
    totals = account.kernel_totals(windows.contained_in(chosen, t.windows))
    return account.kernel_detail_table(totals, rules()).select(
        "trace_id", "window_id", "kernel_name", "category", "call_count", "total_duration_us", "relative_pct", "absolute_pct")


@query
def keyword_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.operator_stats(Trace(spark, sf_dir).slices)


@query
def keyword_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.category_stats(Trace(spark, sf_dir).slices)


@query
def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.advice(keyword.category_stats(Trace(spark, sf_dir).slices))


@query
def top_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.top_operators(keyword.operator_stats(Trace(spark, sf_dir).slices), ["trace_id"], 10)


@query
def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.event_categories(Trace(spark, sf_dir).slices)


@query
def active_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account.category_summary(Trace(spark, sf_dir).totals, rules()).select("trace_id", "window_id", "category_ord", "category")


@query
def classified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_names(Trace(spark, sf_dir).slices, rules()).select(
        "name", "record_count", "detail.category", "detail.reason", "detail.rule_id", "detail.semantic_type", "detail.confidence")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = views.kernel_table(spark, sf_dir).selectExpr("name", "record_count", "CAST(cents AS DOUBLE) AS duration_us")
    return audit.audit([audit.trace_names(Trace(spark, sf_dir).slices), table], rules())


@query
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rollup(_audited(spark, sf_dir)).withColumn("duration_us", F.round("duration_us", 3))


@query
def audit_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unknown(_audited(spark, sf_dir)).select("name", "record_count", F.round("duration_us", 3).alias("duration_us"), "rule_id")


@query
def reclassify_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.kernel_table(spark, sf_dir).selectExpr(
        "table_id", "name", "record_count", "CAST(cents AS DOUBLE) AS total_duration_us",
        "IF(table_id = 'R', NULL, CAST(record_count AS DOUBLE)) AS window_absolute_pct")
    return account.reclassified_table(rows, rules(), ["table_id"])


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even ranks against the next odd rank, window by window."""
    rank = F.substring("trace_id", 9, 1).cast("bigint")
    keyed = df.withColumn("pair_id", F.concat(F.floor(rank / 2).cast("string"), F.lit("/"), F.col("window_id").cast("string"))) \
        .withColumn("_rank", rank)
    return keyed.filter("_rank % 2 = 0"), keyed.filter("_rank % 2 = 1")


def _stages(c: Context) -> DataFrame:
    """Delta-network stages of each window with the window's own stage."""
    return materialize(context.gdn_stage_summary(c.parts, c.anchored_windows).join(
        c.windows.select("trace_id", "window_id", "stage"), ["trace_id", "window_id"]))


def _descriptors(c: Context, stages: DataFrame) -> DataFrame:
    anchors = c.steps.withColumn("window_id", F.expr(f"(ts_ns - {views.ORIGIN_NS}) DIV {views.SLOT_NS}"))
    keys = anchors.select("trace_id", "id", "window_id")
    parsed = steps.annotation_work(anchors).join(keys, ["trace_id", "id"])
    return compare.mixed_by_scope(parsed, stages).selectExpr(
        "trace_id", "window_id", "IF(window_id % 5 = 0, 'prefill', 'decode') AS stage", "mixed",
        "IF(window_id % 7 = 0, substring(trace_id, 9, 1), '0') AS rank", f"'{rules().sha256}' AS rules_sha256",
        "IF(window_id % 5 = 0, prefill_tokens, NULL) AS prefill_tokens", "CAST(NULL AS BIGINT) AS mixed_count",
        "CAST(NULL AS BIGINT) AS mixed_generation_tokens",
        "IF(window_id % 5 = 0, NULL, decode_count + IF(window_id % 9 = 0, CAST(substring(trace_id, 9, 1) AS BIGINT), 0L)) AS decode_count",
        "IF(window_id % 5 = 0, NULL, decode_tokens) AS decode_tokens")


@query
def compare_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    return compare.blockers(*_sides(_descriptors(c, _stages(c))), verified=True)


@query
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    stages = _stages(c)
    blocked = compare.blockers(*_sides(_descriptors(c, stages)), verified=True)
    return compare.compare_categories(*_sides(context.parts_summary(c.parts)), blocked, compare.gdn_comparable(*_sides(stages)))


@query
def time_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    blocked = compare.blockers(*_sides(_descriptors(c, _stages(c))), verified=True)
    return compare.compare_time(*_sides(materialize(account.time_account(c.device, c.windows, rules()))), blocked)


@query
def gdn_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context(spark, sf_dir)
    stages = _stages(c)
    blocked = compare.blockers(*_sides(_descriptors(c, stages)), verified=True)
    return compare.compare_gdn(*_sides(stages), blocked, ("left", "right"))


def _stored_comparison(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Reports of the even and of the odd ranks, written, read back and compared window by window."""
    c = Context(spark, sf_dir)
    parts, chosen = c.parts, c.anchored_windows.withColumn("rank", F.expr("IF(window_id % 7 = 0, substring(trace_id, 9, 1), '0')"))
    stages = materialize(context.gdn_stage_summary(parts, chosen))
    tables = {"summary": context.parts_summary(parts), "kernels": account.kernel_aggregate(c.device, c.windows), "excluded": account.excluded_markers(c.totals, rules()),
              "coverage": account.window_coverage(c.device, c.windows), "time_account": account.time_account(c.device, c.windows, rules()),
              "gdn_stages": stages, "manifest": reports.manifest(chosen, stages, rules())}
    folders = [shared_path(spark), shared_path(spark)]
    for odd, folder in enumerate(folders):
        sinks.write_report({n: t.filter(f"CAST(substring(trace_id, 9, 1) AS BIGINT) % 2 = {odd}") for n, t in tables.items()}, folder)
    left, right = _sides(c.windows)
    pairs = left.selectExpr("pair_id", "trace_id AS left_trace", "window_id AS left_window").join(
        right.selectExpr("pair_id", "trace_id AS right_trace", "window_id AS right_window"), "pair_id", "full")
    return reports.compare_reports(spark, *folders, pairs, verified=True)


@query
def compare_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of two stored reports."""
    return _stored_comparison(spark, sf_dir)["checks"].selectExpr("side", "trace_id", "window_id", "check_name", "round(lhs, 3) AS lhs", "round(rhs, 3) AS rhs", "ok")


@query
def context_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context tokens per second of prefill windows of two stored reports."""
    return _stored_comparison(spark, sf_dir)["rates"]


@query
def rank_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace(spark, sf_dir)
    files = t.slices.select("trace_id").distinct().withColumn("file_name", F.concat(F.lit("/data/"), "trace_id", F.lit(".json.gz")))
    return compare.rank_blocks(account.category_summary(t.totals, rules()), files).select(
        "trace_id", "window_id", "category", "record_count", "rank", "error_code")


@query
def trace_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of raw trace events: complete events in nanoseconds, attributes by normalised key."""
    return traces.slices(views.trace_events(spark, sf_dir)).select(
        "trace_id", "id", "name", "category", "ts_ns", "dur_ns", "host_thread", "correlation", "external_id", "device", "stream")


@query
def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of written trace documents, read back whole, in 8 and in 64 ranges a document."""
    folder = shared_path(spark)
    views.trace_documents(spark, sf_dir, folder)
    files = documents.listed(spark, folder).selectExpr("path", "size")
    most = max(1, files.agg(F.max("size")).first()[0] or 1)
    out = None
    for splits in (1, 8, 64):
        events = traces.read_large_traces(spark, folder, -(-most // splits)).select(
            F.lit(splits).alias("splits"), F.regexp_extract("trace_id", "trace_id=([^/]*)/", 1).alias("trace_id"), "ord", "ph", "cat", "name", "pid", "tid",
            F.expr("CAST(ts_us * 1000 AS BIGINT)").alias("ts_ns"), F.expr("CAST(dur_us * 1000 AS BIGINT)").alias("dur_ns"), "flow_id",
            F.expr("try_element_at(args, 'stream')").alias("stream"))
        out = events if out is None else out.unionByName(events)
    return out


@query
def kernel_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of written kernel tables with the physical line each stands in."""
    folder = shared_path(spark)
    views.kernel_table_files(spark, sf_dir, folder)
    return tables.raw_kernel_rows(tables.read_delimited(spark, folder)).select(
        F.regexp_extract("table_id", "table_id=([^/]*)/", 1).alias("table_id"), "source_row", F.nullif("name", F.lit("")).alias("name"), "record_count", "total_duration_us", "error_code")


@query
def window_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows asked for relative to the trace start, checked, with what they select."""
    t = Trace(spark, sf_dir)
    bounds = windows.trace_bounds(t.slices)
    return windows.request_metadata(t.device, windows.relative_windows(views.window_requests(t.slices, bounds), bounds))


@query
def gemm_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gemm.rocblas_cases(views.gemm_lines(spark, sf_dir))


@query
def gemm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gemm.log_results(views.gemm_logs(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gemm.compare(gemm.rocblas_cases(views.gemm_lines(spark, sf_dir)), gemm.log_results(views.gemm_logs(spark, sf_dir)))


@query
def gemm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select(
        "line", "m", "n", "k", "transA", "case_group", "baseline_kernel", "baseline_gflops", "baseline_us", "optimized_kernel",
        "optimized_gflops", "optimized_us", "gflops_pct", "us_pct")


@query
def gemm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gemm.statistics(_compared(spark, sf_dir), ["case_group"])


def _occupancy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cards, processes = occupancy.csv_records(views.monitor_lines(spark, sf_dir))
    return cards, occupancy.owners(processes, views.pid_lookup(spark, sf_dir))


@query
def card_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir)[1]


@query
def card_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.card_state(*_occupancy(spark, sf_dir))


@query
def idle_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.idle_cards(_occupancy(spark, sf_dir)[0]).select("node", "card", "bus")


@query
def phase_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.phase_fields(views.phase_scopes(spark, sf_dir)).drop("pid", "tid", "ts_ns", "dur_ns")


@query
def launch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.launch_counts(views.phase_scopes(spark, sf_dir), annotations.graph_launches(views.launch_rows(spark, sf_dir)))


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.distinct_dumps(views.dumps(spark, sf_dir), 900_000_000_000_000_000, 950_000_000_000_000_000)


@query
def dump_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumps(spark, sf_dir)


@query
def dump_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.dump_counts(_dumps(spark, sf_dir))
