"""Context roles: expert GEMM and gated-delta-network work told apart by the host scope that launched it.

Scope membership is a property of runtime calls. An event takes a role only if all its candidate
launches have it, which the link profile answers by counts and bit masks, without listing launches.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (GDN_COMPARISON_GROUPS, GDN_CORE_OPS, GDN_CORE_SUBSCOPES, GDN_DECODE_GROUP, GDN_METADATA_KERNELS, GDN_NORM_OP,
                            GDN_OPERATOR_GROUPS, GDN_OUTPUT_SYMBOLS, GDN_PYTHON_SCOPES, GDN_SHARED_CATEGORIES,
                            GDN_UNALIGNED_GROUP, CONTEXT_ANNOTATION)
from ..functions.expressions import ns_to_us
from ..session import materialize
from ..sources.rules import RuleSet
from .account import category_columns, classified, kernel_totals, unfold_categories
from .attribution import GRAPH_LAUNCH
from .classify import classify_names, host_rule, sql_text
from .links import least_scopes, link_profile
from .windows import WINDOW_KEYS, started_in

# Host operators of the convolution, as patterns.
CONV_UPDATE = r"%::%causal\_conv1d\_update"
CONV_FORWARD = r"%::%causal\_conv1d\_fn"
SCOPE_BITS = {name: 1 << n for n, name in enumerate((
    "core", "output", "metadata", "rearrange", "gating", "qk_norm", "chunk_fwd", "recurrent", "recurrent_fused",
    "recurrent_packed", "conv_update", "conv_forward", "output_norm"))}
# Scopes that count only inside the core operator, in the order roles are decided, with the role each gives.
CORE_ROLES = {
    "conv_update": "gdn_conv_update", "conv_forward": "gdn_conv", "rearrange": "gdn_rearrange_qkv", "gating": "gdn_gating",
    "qk_norm": "gdn_qk_norm", "chunk_fwd": "gdn_chunk_fwd_internal", "recurrent": "gdn_recurrent",
    "recurrent_fused": "gdn_recurrent_fused", "recurrent_packed": "gdn_recurrent_packed",
}


def expert_launches(slices: DataFrame, runtimes: DataFrame, rules: RuleSet) -> DataFrame:
    """Expert host operation that encloses each runtime call; the latest starting one wins."""
    ops = slices.filter("category = 'cpu_op'").withColumn("expert_rule", host_rule(rules)).filter("expert_rule IS NOT NULL") \
        .withColumn("host_op", F.col("name")).withColumn("_ts", F.expr("-ts_ns")).withColumn("_id", F.expr("-id"))
    return least_scopes(ops, runtimes, ["_ts", "_id"], ("host_op", "expert_rule")).selectExpr("trace_id", "runtime_id", "lanes[0].least[0] AS s").selectExpr(
        "trace_id", "runtime_id", "-s._id AS scope_id", "s.host_op", "s.expert_rule")


def expert_profile(device: DataFrame, runtimes: DataFrame, flows: DataFrame, experts: DataFrame) -> DataFrame:
    """Device events with their expert scope: ``confirmed`` by all candidate launches, or
    ``conflicting-links-same-expert-scope`` where conflicting links agree on one finished scope."""
    marked = runtimes.join(experts.selectExpr("trace_id", "runtime_id AS id", "scope_id", "host_op", "expert_rule"),
                           ["trace_id", "id"], "left")
    profile = link_profile(device, marked, flows, {
        "experts": ("sum", "IF(scope_id IS NULL, 0, 1)"), "scope_lo": ("min", "scope_id"), "scope_hi": ("max", "scope_id"),
        "rule": ("min", "struct(id, expert_rule)"), "last_ts": ("max", "ts_ns"), "least_dur": ("min", "dur_ns")})
    confirmed = "candidate_count > 0 AND cand_experts = candidate_count"
    agreed = ("basis = 'conflicting-flow-correlation' AND poss_experts = possible_count AND poss_scope_lo = poss_scope_hi "
              "AND dur_ns >= 0 AND poss_least_dur >= 0 AND poss_last_ts <= ts_ns")
    return profile.selectExpr(
        *device.columns, "basis", "candidate_count", "possible_count",
        f"CASE WHEN {confirmed} THEN basis WHEN {agreed} THEN 'conflicting-links-same-expert-scope' END AS expert_basis",
        f"CASE WHEN {confirmed} THEN cand_rule.expert_rule WHEN {agreed} THEN poss_rule.expert_rule END AS expert_rule",
        "coalesce(poss_experts, 0) > 0 AS touches_expert")


def moe_split(profile: DataFrame, windows: DataFrame, rules: RuleSet) -> DataFrame:
    """Parts of generic GEMM kernels: expert calls, residual calls, or one whole row where nothing splits.

    Event lists stay in the profile; parts carry counts and integer time.
    """
    generic = classify_names(profile, rules, ["category", "rule_id"]).filter("detail.category = 'gemm'").selectExpr(
        "name", "detail.rule_id AS base_rule")
    grouped = started_in(profile, windows).join(generic, "name").groupBy(*WINDOW_KEYS, "name", "base_rule").agg(
        F.expr("count(1) AS n"), F.expr("sum(dur_ns) AS ns"), F.expr("count_if(expert_basis IS NOT NULL) AS n_expert"),
        F.expr("coalesce(sum(IF(expert_basis IS NOT NULL, dur_ns, 0L)), 0L) AS ns_expert"),
        F.expr("count_if(expert_basis IS NULL AND touches_expert) AS n_ambiguous"),
        F.expr("count_if(expert_basis = 'conflicting-links-same-expert-scope') AS n_conflict"),
        F.expr("min(expert_rule) AS expert_rule")).filter("n_expert > 0 OR n_ambiguous > 0")
    launch = "IF(n_conflict > 0, 'ambiguous', 'confirmed-within-recorded-links')"
    part = ("named_struct('part', '{part}', 'record_count', {n}, 'duration_ns', {ns}, 'category', '{category}', "
            "'rule_id', {rule}, 'confidence', '{confidence}', 'launch_confidence', {launch})")
    whole = part.format(part="expert", n="n", ns="ns", category="group gemm", rule="expert_rule", confidence="high", launch=launch)
    expert = part.format(part="expert", n="n_expert", ns="ns_expert", category="group gemm", rule="expert_rule",
                         confidence="high", launch=launch)
    rest = part.format(part="residual", n="n - n_expert", ns="ns - ns_expert", category="gemm", rule="base_rule",
                       confidence="unknown", launch="CAST(NULL AS STRING)")
    return grouped.selectExpr(
        *WINDOW_KEYS, "name", "n AS observed_count", "n_ambiguous AS ambiguous_count", "n_conflict AS resolved_conflict_count",
        f"inline(CASE WHEN n_expert = n THEN array({whole}) WHEN n_expert > 0 THEN array({expert}, {rest}) ELSE array({rest}) END)")


def launch_conflicts(profile: DataFrame, runtimes: DataFrame, flows: DataFrame) -> DataFrame:
    """Possible launches of events whose conflicting links agree on one expert scope, a row per launch."""
    kept = profile.filter("expert_basis = 'conflicting-links-same-expert-scope'").selectExpr(
        "trace_id", "id AS event_id", "correlation", "expert_rule")
    calls = runtimes.selectExpr("trace_id", "id AS launch_id", "correlation AS launch_correlation", "ts_ns AS launch_ts")
    by_id = kept.join(calls.withColumn("correlation", F.col("launch_correlation")), ["trace_id", "correlation"])
    by_flow = flows.selectExpr("trace_id", "slice_out AS launch_id", "slice_in AS event_id").join(
        kept, ["trace_id", "event_id"]).join(calls, ["trace_id", "launch_id"])
    columns = ["trace_id", "event_id", "correlation", "expert_rule", "launch_id", "launch_correlation", "launch_ts"]
    return by_id.select(*columns).unionByName(by_flow.select(*columns)).distinct()


def _scope_bits() -> str:
    """SQL for the scope bits a host interval stands for, by name and recorded arguments."""
    b = SCOPE_BITS
    core = ", ".join(sql_text(n) for n in GDN_CORE_OPS)
    owner = (f"CASE WHEN name IN ({core}) THEN {b['core']} WHEN endswith(name, ': _output_projection') THEN {b['output']} "
             f"WHEN endswith(name, ': _build_chunk_metadata') THEN {b['metadata']} ELSE 0 END")
    inner = "CASE " + " ".join(f"WHEN endswith(name, {sql_text(suffix)}) THEN {b[scope]}"
                               for suffix, scope in GDN_CORE_SUBSCOPES.items()) + " ELSE 0 END"
    conv = (f"CASE WHEN endswith(name, 'causal_conv1d_update') THEN {b['conv_update']} "
            f"WHEN endswith(name, 'causal_conv1d_fn') THEN {b['conv_forward']} ELSE 0 END")
    norm = (f"CASE WHEN name = '{GDN_NORM_OP}' AND norm_mode = '5' THEN {b['qk_norm']} "
            f"WHEN name = '{GDN_NORM_OP}' AND norm_mode = '2' AND coalesce(gate_type, '') <> '' THEN {b['output_norm']} ELSE 0 END")
    return f"({owner}) | ({inner}) | ({conv}) | ({norm})"


def gdn_scopes(slices: DataFrame) -> DataFrame:
    """Host intervals that delimit gated-delta-network work, with their scope bits."""
    ops = ", ".join(sql_text(n) for n in [*GDN_CORE_OPS, GDN_NORM_OP, *[n for n in GDN_CORE_SUBSCOPES if n.startswith("_C_sdaa::")]])
    frames = " OR ".join(f"name ILIKE {sql_text(p)}" for p in (q.replace("_", r"\_") for q in GDN_PYTHON_SCOPES))
    named = (f"(category = 'cpu_op' AND (name IN ({ops}) OR name ILIKE {sql_text(CONV_UPDATE)} "
             f"OR name ILIKE {sql_text(CONV_FORWARD)})) OR (category = 'python_function' AND ({frames}))")
    return slices.filter("dur_ns >= 0").filter(named).withColumn("bits", F.expr(_scope_bits()))


def gdn_profile(slices: DataFrame, device: DataFrame, runtimes: DataFrame, flows: DataFrame) -> DataFrame:
    """Device events with their gated-delta-network ``role`` and whether they may come from a graph replay."""
    b = SCOPE_BITS
    scopes = gdn_scopes(slices).withColumn("_last", F.expr("-(ts_ns + dur_ns)"))  # the scope of a kind that ends last encloses a call if any does
    masks = least_scopes(scopes, runtimes, ["_last"], lanes=("bits",)).selectExpr(
        "trace_id", "runtime_id AS id", "aggregate(lanes, 0, (m, x) -> m | x.bits) AS mask")
    in_core = sum(b[n] for n in CORE_ROLES)
    effective = (f"mask & ~(IF(mask & {b['core']} = 0, {in_core}, 0) | IF(mask & {b['output']} = 0, {b['output_norm']}, 0))")
    marked = runtimes.join(masks, ["trace_id", "id"], "left").withColumn("mask", F.expr("coalesce(mask, 0)"))
    profile = link_profile(device, marked, flows, {
        "mask": ("bit_and", effective), "graph": ("max", f"IF({GRAPH_LAUNCH.format(n='name')}, 1, 0)")})
    symbols = " ".join(f"WHEN lower(name) = {sql_text(s)} AND m & {b['output']} <> 0 THEN '{r}'" for s, r in GDN_OUTPUT_SYMBOLS.items())
    scoped = " ".join(f"WHEN m & {b[s]} <> 0 THEN '{r}'" for s, r in CORE_ROLES.items())
    role = (f"CASE WHEN candidate_count = 0 OR cand_graph = 1 THEN NULL WHEN m & {b['metadata']} <> 0 THEN 'gdn_metadata' "
            f"WHEN m & {b['output_norm']} <> 0 THEN 'gdn_output_norm' {symbols} WHEN m & {b['core']} = 0 THEN NULL {scoped} "
            "WHEN contains(lower(name), 'fusednormargs') THEN NULL "
            "WHEN contains(lower(name), 'causal_conv1d') THEN CASE WHEN contains(lower(name), 'update') THEN 'gdn_conv_update' "
            "WHEN contains(lower(name), '_fwd_') THEN 'gdn_conv' ELSE 'gdn_conv_shared' END "
            "WHEN lower(name) = '_fused_post_conv_kernel' THEN 'gdn_gating_qk_fused' "
            "WHEN category IN ('gpu_memcpy', 'gpu_memset') THEN 'gdn_memory' ELSE 'gdn_aux' END")
    shared = ", ".join(sql_text(s) for s in GDN_OUTPUT_SYMBOLS)
    return profile.selectExpr("*", "coalesce(cand_mask, 0) AS m").selectExpr(
        *device.columns, "basis", f"{role} AS role",
        "coalesce(poss_graph, 0) = 1 AND (contains(lower(name), 'causal_conv1d') OR contains(lower(name), 'fusednormargs') "
        f"OR lower(name) IN ({shared})) AS replayable")


def gdn_split(profile: DataFrame, windows: DataFrame, slices: DataFrame, rules: RuleSet) -> DataFrame:
    """Parts of shared kernels by role, for names with at least one confirmed role or replay candidate.

    Only windows with a dedicated recurrent kernel, or traces with a core operator, are looked at.
    """
    classes = classify_names(profile, rules, ["category", "semantic_type"])
    active = started_in(profile, windows).join(classes.drop("record_count"), "name")
    if rules.schema_version < 3 or rules.platform == "dcu":
        active = active.filter(F.lit(False))
    recurrent = active.filter("detail.category = 'GDN' AND startswith(detail.semantic_type, 'gdn_recurrent')") \
        .select(*WINDOW_KEYS).distinct().withColumn("recurrent", F.lit(True))
    cores = slices.filter(F.col("category") == "cpu_op").filter(F.col("name").isin(GDN_CORE_OPS)).select("trace_id").distinct() \
        .withColumn("has_core", F.lit(True))
    shared = ", ".join(sql_text(c) for c in GDN_SHARED_CATEGORIES)
    judged = active.filter(f"detail.category IN ({shared})").join(recurrent, WINDOW_KEYS, "left").join(cores, "trace_id", "left") \
        .filter("recurrent OR has_core")
    parts = judged.groupBy(*WINDOW_KEYS, "name", F.col("detail.category").alias("base_category"), "role").agg(
        F.expr("count(1) AS record_count"), F.expr("sum(dur_ns) AS duration_ns"),
        F.expr("count_if(role IS NULL AND recurrent AND replayable) AS replay_count"),
        F.expr("coalesce(sum(IF(role IS NULL AND recurrent AND replayable, dur_ns, 0L)), 0L) AS replay_ns"))
    kept = parts.filter("role IS NOT NULL OR replay_count > 0").select(*WINDOW_KEYS, "name").distinct()
    return parts.join(kept, [*WINDOW_KEYS, "name"], "left_semi").selectExpr(
        *WINDOW_KEYS, "name", "role", "record_count", "duration_ns", "IF(role IS NULL, base_category, 'GDN') AS category",
        "replay_count", "replay_ns")


def kernel_parts(selected: DataFrame, moe: DataFrame, gdn: DataFrame, rules: RuleSet) -> DataFrame:
    """Contributions of every kernel: context parts where a name was split or moved, else the whole row. A part carries the calls and time
    of its replay candidates, which stay open: they count in the part's own category."""
    whole = classified(kernel_totals(selected), rules, "category", "semantic_type", "rule_id", "confidence")
    base = whole.selectExpr(*WINDOW_KEYS, "name", "record_count", "duration_ns", "start_ns", "end_ns", "detail.category AS category",
                            "detail.semantic_type AS semantic_type", "detail.rule_id AS rule_id", "detail.confidence AS confidence")
    keys = [*WINDOW_KEYS, "name"]
    spans = base.select(*keys, "start_ns", "end_ns", F.col("semantic_type").alias("base_type"), F.col("rule_id").alias("base_rule"),
                        F.col("confidence").alias("base_confidence"))
    from_moe = moe.join(spans, keys).selectExpr(
        *keys, "record_count", "duration_ns", "start_ns", "end_ns", "category",
        "IF(part = 'expert', 'moe_expert_group_gemm', base_type) AS semantic_type", "rule_id", "confidence", "TRUE AS from_context", "0L AS replay_count", "0L AS replay_ns")
    from_gdn = gdn.join(spans, keys).selectExpr(
        *keys, "record_count", "duration_ns", "start_ns", "end_ns", "category", "coalesce(role, base_type) AS semantic_type",
        "IF(role IS NULL, base_rule, concat('gdn.context.', role)) AS rule_id",
        "IF(role IS NULL, base_confidence, 'high') AS confidence", "FALSE AS from_context", "replay_count", "replay_ns")
    split = from_moe.unionByName(from_gdn)
    plain = base.selectExpr("*", "FALSE AS from_context", "0L AS replay_count", "0L AS replay_ns")
    return plain.join(split.select(*keys).distinct(), keys, "left_anti").unionByName(split)


def parts_summary(parts: DataFrame) -> DataFrame:
    """Category rollup over contributions; a name counts once per category it contributes to."""
    per_name = parts.groupBy(*WINDOW_KEYS, "name", "category").agg(
        F.expr("sum(record_count) AS record_count"), F.expr("sum(duration_ns) AS duration_ns"), F.min("start_ns").alias("start_ns"),
        F.min("end_ns").alias("end_ns"), F.expr("bool_or(startswith(semantic_type, 'moe_') OR from_context) AS moe"))
    sums = per_name.groupBy(*WINDOW_KEYS).agg(
        *category_columns("category", "record_count", "duration_ns"),
        F.expr("sum(IF(category IS NULL, 0L, duration_ns)) AS busy_ns"), F.min("start_ns").alias("start_ns"),
        F.min("end_ns").alias("end_ns"), F.expr("bool_or(moe) AS moe"))
    flat = unfold_categories(sums, WINDOW_KEYS, ["busy_ns", "start_ns", "end_ns"], "moe")
    return flat.selectExpr(
        *WINDOW_KEYS, "category_ord", "category", "kernel_kinds", "record_count", "duration_ns / 1000D AS total_duration_us",
        "try_divide(CAST(duration_ns AS DOUBLE), CAST(busy_ns AS DOUBLE)) * 100D AS kernel_relative_pct",
        "CAST(duration_ns AS DOUBLE) / CAST(end_ns - start_ns AS DOUBLE) * 100D AS window_absolute_pct")


def downgraded_gemm(parts: DataFrame) -> DataFrame:
    """Generic GEMM rows whose role stays open: expert helpers ran in the window, expert GEMM was not seen."""
    flags = parts.groupBy(*WINDOW_KEYS).agg(
        F.expr("bool_or(startswith(semantic_type, 'moe_') OR from_context) AS moe"),
        F.expr("bool_or(coalesce(category = 'group gemm', FALSE)) AS expert_seen")).filter("moe AND NOT expert_seen")
    return parts.filter("category = 'gemm'").join(flags.select(*WINDOW_KEYS), WINDOW_KEYS, "left_semi").selectExpr(
        *WINDOW_KEYS, "name", "record_count", "confidence AS name_rule_confidence", "'unknown' AS confidence",
        "array('gemm', 'group gemm') AS category_candidates")


def _group_case(groups: dict[str, list[str]], otherwise: str) -> str:
    arms = " ".join(f"WHEN semantic_type IN ({', '.join(sql_text(t) for t in types)}) THEN {sql_text(g)}" for g, types in groups.items())
    return f"CASE {arms} ELSE {otherwise} END"


def gdn_stage_summary(parts: DataFrame, windows: DataFrame) -> DataFrame:
    """Gated-delta-network rows per comparison group; decode windows merge preparation and recurrence.

    ``windows`` may carry the step ``anchor`` whose counts reveal a mixed window. ``graph_candidates`` is the number of kernel names of the
    window with open replay candidates; ``metadata_operator`` names the kernel that prepared metadata.
    """
    g = GDN_COMPARISON_GROUPS
    prefill = ", ".join(sql_text(t) for t in ["gdn_conv", "gdn_gating_qk_fused", *g["Chunk 主计算"]])
    decode = ", ".join(sql_text(t) for t in ["gdn_conv_update", *g["递推主计算"]])
    mine = parts.filter("category = 'GDN'")
    flags = mine.groupBy(*WINDOW_KEYS).agg(F.expr(f"bool_or(semantic_type IN ({prefill})) AS has_prefill"),
                                           F.expr(f"bool_or(semantic_type IN ({decode})) AS has_decode"))
    anchored = windows if "anchor" in windows.columns else windows.withColumn("anchor", F.lit(None).cast("string"))
    count = "CAST(nullif(regexp_extract(coalesce(anchor, ''), {p}, {i}), '') AS BIGINT) > 0"
    mixed = " AND ".join(f"coalesce({count.format(p=sql_text(CONTEXT_ANNOTATION), i=i)}, FALSE)" for i in (1, 3))
    scoped = flags.join(anchored.select(*WINDOW_KEYS, "stage", "anchor"), WINDOW_KEYS).selectExpr(
        *WINDOW_KEYS, f"CASE WHEN ({mixed}) OR (has_prefill AND has_decode) OR (stage = 'prefill' AND has_decode) "
        "OR (stage = 'decode' AND has_prefill) THEN 'mixed-or-stage-mismatch' WHEN stage IN ('prefill', 'decode') THEN stage "
        "ELSE 'unknown' END AS scope")
    merged = {k: v for k, v in g.items() if k not in ("卷积后准备", "递推主计算")} | {GDN_DECODE_GROUP: g["卷积后准备"] + g["递推主计算"]}
    group = f"IF(scope = 'decode', {_group_case(merged, sql_text(GDN_UNALIGNED_GROUP))}, {_group_case(g, sql_text(GDN_UNALIGNED_GROUP))})"
    rows = mine.join(scoped, WINDOW_KEYS).withColumn("group", F.expr(group))
    known = [f"IF(semantic_type = 'gdn_metadata' AND {match}(name, {sql_text(word)}), {sql_text(label)}, NULL)" for match, word, label in GDN_METADATA_KERNELS]
    candidates = parts.groupBy(*WINDOW_KEYS).agg(F.expr("count(DISTINCT IF(replay_count > 0, name, NULL)) AS graph_candidates"))
    return rows.join(candidates, WINDOW_KEYS).groupBy(*WINDOW_KEYS, "scope", "group", "graph_candidates").agg(
        F.expr(f"coalesce({', '.join(f'max({k})' for k in known)}) AS metadata_operator"),
        F.expr("sum(record_count) AS record_count"), F.expr("sum(duration_ns) / 1000D AS total_duration_us"),
        F.expr("count(DISTINCT name) AS kernel_kinds"), F.expr("array_sort(collect_set(semantic_type)) AS semantic_types"))


def gdn_operators(parts: DataFrame) -> DataFrame:
    """Gated-delta-network calls, time and distinct kernels per operator label."""
    return parts.filter("category = 'GDN'").withColumn("label", F.expr(_group_case(GDN_OPERATOR_GROUPS, "semantic_type"))) \
        .groupBy(*WINDOW_KEYS, "label").agg(F.expr("sum(record_count) AS calls"), ns_to_us(F.sum("duration_ns")).alias("total_duration_us"),
                                            F.countDistinct("name").alias("kernel_kinds"))


def context_parts(slices: DataFrame, device: DataFrame, runtimes: DataFrame, flows: DataFrame, windows: DataFrame,
                  rules: RuleSet) -> DataFrame:
    """All contributions of all windows with both kinds of context applied; stored, as reports read them often."""
    experts = expert_launches(slices, runtimes, rules)
    moe = moe_split(materialize(expert_profile(device, runtimes, flows, experts)), windows, rules)
    gdn = gdn_split(materialize(gdn_profile(slices, device, runtimes, flows)), windows, slices, rules)
    return materialize(kernel_parts(started_in(device, windows), materialize(moe), materialize(gdn), rules))
