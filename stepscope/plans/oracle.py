"""DuckDB statements equivalent to the registered queries."""
from __future__ import annotations

from ..fixed_values import (ADVICE_THRESHOLDS, BLOCKER_MIXED, BLOCKER_RANK, BLOCKER_RULES, BLOCKER_STAGE, BLOCKER_WORK, BUBBLE_LABEL, CATEGORY_ORDER,
                            DENSE_CATEGORIES, DEVICE_NAMES, GDN_COMPARISON_GROUPS, GDN_COMPARISON_OPERATORS, GDN_CONFIRMED_SUBSET, GDN_CORE_STAGES, GDN_METADATA_GROUP,
                            GDN_DECODE_GROUP, GDN_OPERATOR_GROUPS, GDN_UNALIGNED_GROUP, KEYWORD_CATEGORIES,
                            KEYWORD_KERNEL_FALLBACK, PHASE_KEYWORDS, TIME_ROWS, TOTAL_LABEL, UNINFORMATIVE_FRAMES)
from ..sources.rules import load_rules
from .driver_views import HOUR_NS, MAPPING_END_NS
from .oracle_views import V_FLOW, V_FORWARD, V_SLICE, V_STEP, V_WINDOW, V_SLOT, text, text_list

SQL: dict[str, str] = {}
RULES = load_rules()


def with_views(*parts: str) -> str:
    """Common table expressions followed by the final statement."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def _case(name: str, attribute, rules, fallback) -> str:
    """First matching rule attribute of a name, as SQL."""
    arms = [f"WHEN regexp_matches({name}, {text(p)}, 'i') THEN {attribute(r)}" for r in rules for p in r.patterns]
    return "CASE " + " ".join(arms) + f" ELSE {fallback} END"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return text_list(value) if isinstance(value, list) else text(value)


def rule_case(name: str, attribute: str) -> str:
    return _case(name, lambda r: _literal(getattr(r, attribute)), RULES.kernel_rules,
                 _literal(getattr(RULES.fallback, attribute)))


V_CLASS = "v_class AS (SELECT name, " + ", ".join(
    f"{rule_case('name', a)} AS {a}" for a in
    ("category", "reason", "rule_id", "semantic_type", "confidence")) + \
    " FROM (SELECT DISTINCT name FROM v_slice))"
V_STARTED = """
v_started AS (
  SELECT w.trace_id, w.window_id, w.start_ns, w.end_ns, d.id, d.name, d.ts_ns, d.dur_ns, d.track_id
  FROM v_device d JOIN v_window w ON d.trace_id = w.trace_id AND d.ts_ns >= w.start_ns AND d.ts_ns < w.end_ns)"""
V_TOTALS = V_STARTED + """,
v_totals AS (
  SELECT trace_id, window_id, name, count(*) AS record_count, CAST(sum(dur_ns) AS BIGINT) AS duration_ns,
         min(start_ns) AS start_ns, min(end_ns) AS end_ns
  FROM v_started GROUP BY ALL),
v_detail AS (SELECT t.*, c.* EXCLUDE (name) FROM v_totals t JOIN v_class c USING (name))"""
V_CATEGORY = "v_category(category_ord, category) AS (VALUES " + ", ".join(
    f"({i}, {text(c)})" for i, c in enumerate(CATEGORY_ORDER)) + ")"
DENSE = "(" + ", ".join(text(c) for c in DENSE_CATEGORIES) + ")"
V_COVER = """
v_touch AS (
  SELECT trace_id, window_id, start_ns, end_ns, ts_ns, dur_ns, TRUE AS sel FROM v_started
  UNION ALL
  SELECT w.trace_id, w.window_id, w.start_ns, w.end_ns, d.ts_ns, d.dur_ns, FALSE
  FROM v_device d JOIN v_window w ON d.trace_id = w.trace_id AND d.ts_ns < w.start_ns AND d.ts_ns + d.dur_ns > w.start_ns),
v_clip AS (
  SELECT trace_id, window_id, greatest(ts_ns, start_ns) AS s, least(ts_ns + dur_ns, end_ns) AS e, sel
  FROM v_touch WHERE dur_ns > 0),
v_gain AS (
  SELECT trace_id, window_id, sel,
    greatest(e - greatest(s, coalesce(max(e) OVER p, s)), 0) AS g_all,
    CASE WHEN sel THEN greatest(e - greatest(s, coalesce(max(CASE WHEN sel THEN e END) OVER p, s)), 0) ELSE 0 END AS g_sel
  FROM v_clip
  WINDOW p AS (PARTITION BY trace_id, window_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v_union AS (SELECT trace_id, window_id, CAST(sum(g_all) AS BIGINT) AS u_all, CAST(sum(g_sel) AS BIGINT) AS u_sel FROM v_gain GROUP BY ALL),
v_sum AS (
  SELECT trace_id, window_id, CAST(sum(CASE WHEN sel THEN dur_ns ELSE 0 END) AS BIGINT) AS s_sum,
         count_if(NOT sel) AS n_carry FROM v_touch GROUP BY ALL),
v_cov AS (
  SELECT w.trace_id, w.window_id, w.end_ns - w.start_ns AS window_ns, coalesce(s_sum, 0) AS sum_ns,
         coalesce(n_carry, 0) AS n_carry, coalesce(u_sel, 0) AS sel_ns, coalesce(u_all, 0) AS cov_ns
  FROM v_window w LEFT JOIN v_sum USING (trace_id, window_id) LEFT JOIN v_union USING (trace_id, window_id))"""
V_BUSY = """
v_busy AS (
  SELECT c.*, coalesce(b.busy_ns, 0) AS busy_ns, coalesce(b.excluded_ns, 0) AS excluded_ns
  FROM v_cov c LEFT JOIN (
    SELECT trace_id, window_id, CAST(sum(CASE WHEN category IS NULL THEN 0 ELSE duration_ns END) AS BIGINT) AS busy_ns,
           CAST(sum(CASE WHEN category IS NULL THEN duration_ns ELSE 0 END) AS BIGINT) AS excluded_ns
    FROM v_detail GROUP BY ALL) b USING (trace_id, window_id))"""
WINDOWED = [V_SLICE, V_WINDOW, V_CLASS, V_TOTALS]
ACCOUNTED = [*WINDOWED, V_COVER, V_BUSY]

SQL["category_summary"] = with_views(*WINDOWED, V_CATEGORY, """
v_win AS (
  SELECT trace_id, window_id, min(start_ns) AS start_ns, min(end_ns) AS end_ns,
         CAST(sum(CASE WHEN category IS NULL THEN 0 ELSE duration_ns END) AS BIGINT) AS busy_ns,
         bool_or(starts_with(semantic_type, 'moe_')) AS moe
  FROM v_detail GROUP BY ALL)""", """
v_cat AS (
  SELECT trace_id, window_id, category, count(*) AS kinds, CAST(sum(record_count) AS BIGINT) AS n,
         CAST(sum(duration_ns) AS BIGINT) AS d FROM v_detail WHERE category IS NOT NULL GROUP BY ALL)""", f"""
SELECT w.trace_id, w.window_id, k.category_ord, k.category, coalesce(c.kinds, 0) AS kernel_kinds,
       coalesce(c.n, 0) AS record_count, coalesce(c.d, 0) / 1000.0::DOUBLE AS total_duration_us,
       CAST(coalesce(c.d, 0) AS DOUBLE) / nullif(CAST(w.busy_ns AS DOUBLE), 0) * 100.0::DOUBLE AS kernel_relative_pct,
       CAST(coalesce(c.d, 0) AS DOUBLE) / CAST(w.end_ns - w.start_ns AS DOUBLE) * 100.0::DOUBLE AS window_absolute_pct
FROM v_win w CROSS JOIN v_category k LEFT JOIN v_cat c USING (trace_id, window_id, category)
WHERE k.category IN {DENSE} OR c.n > 0 OR (k.category = 'group gemm' AND w.moe)""")

SQL["kernel_window_agg"] = with_views(*WINDOWED, """
SELECT trace_id, window_id, name, record_count, duration_ns / 1000.0::DOUBLE AS total_duration_us,
  (duration_ns // record_count) / 1000.0::DOUBLE AS avg_duration_us,
  floor(duration_ns * 100.0::DOUBLE / nullif(CAST(sum(duration_ns) OVER (PARTITION BY trace_id, window_id) AS BIGINT), 0) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS kernel_relative_pct,
  floor(duration_ns * 100.0::DOUBLE / (end_ns - start_ns) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS window_absolute_pct
FROM v_totals""")

SQL["kernel_detail"] = with_views(*WINDOWED, "v_lists AS (SELECT name, " + ", ".join(
    f"{rule_case('name', a)} AS {a}" for a in ("evidence", "ambiguity_reasons", "category_candidates")) +
    " FROM (SELECT DISTINCT name FROM v_slice))", """
SELECT trace_id, window_id, name AS kernel_name, category, reason, rule_id, semantic_type, confidence,
  CAST(evidence AS VARCHAR[]) AS evidence, CAST(ambiguity_reasons AS VARCHAR[]) AS ambiguity_reasons,
  CAST(category_candidates AS VARCHAR[]) AS category_candidates,
  record_count AS call_count, duration_ns / 1000.0::DOUBLE AS total_duration_us,
  CAST(duration_ns AS DOUBLE) / record_count / 1000.0::DOUBLE AS avg_duration_us,
  CAST(duration_ns AS DOUBLE) / CAST(sum(duration_ns) OVER (PARTITION BY trace_id, window_id) AS DOUBLE) * 100.0::DOUBLE AS relative_pct,
  CAST(duration_ns AS DOUBLE) / CAST(end_ns - start_ns AS DOUBLE) * 100.0::DOUBLE AS absolute_pct
FROM v_detail JOIN v_lists USING (name) WHERE category IS NOT NULL""")

SQL["category_report"] = with_views(*WINDOWED, V_CATEGORY, """
v_win AS (
  SELECT trace_id, window_id, min(end_ns) - min(start_ns) AS window_ns, CAST(sum(duration_ns) AS BIGINT) AS busy_ns,
         count(*) AS kinds, CAST(sum(record_count) AS BIGINT) AS calls
  FROM v_detail WHERE category IS NOT NULL GROUP BY ALL)""", f"""
v_rows AS (
  SELECT trace_id, window_id, category_ord AS row_ord, category, count(*) AS kernel_kinds,
         CAST(sum(record_count) AS BIGINT) AS call_count, CAST(sum(duration_ns) AS BIGINT) AS ns
  FROM v_detail JOIN v_category USING (category) GROUP BY ALL
  UNION ALL SELECT trace_id, window_id, 8, {text(BUBBLE_LABEL)}, 0, 0, greatest(window_ns - busy_ns, 0) FROM v_win
  UNION ALL SELECT trace_id, window_id, 9, {text(TOTAL_LABEL)}, kinds, calls, window_ns FROM v_win)""", """
SELECT trace_id, window_id, row_ord, category, kernel_kinds, call_count, ns / 1000.0::DOUBLE AS total_duration_us,
  CASE WHEN row_ord = 9 THEN 100.0::DOUBLE WHEN row_ord < 8 THEN CAST(ns AS DOUBLE) / CAST(busy_ns AS DOUBLE) * 100.0::DOUBLE END AS relative_pct,
  CASE WHEN row_ord = 9 THEN 100.0::DOUBLE ELSE CAST(ns AS DOUBLE) / CAST(window_ns AS DOUBLE) * 100.0::DOUBLE END AS absolute_pct
FROM v_rows JOIN v_win USING (trace_id, window_id)""")

SQL["excluded_markers"] = with_views(*WINDOWED, """
SELECT trace_id, window_id, CASE WHEN name IN ('WAIT', 'SET') THEN '非计算/' || name ELSE '非计算/排除' END AS category,
  count(*) AS kernel_kinds, CAST(sum(record_count) AS BIGINT) AS record_count,
  CAST(sum(duration_ns) AS BIGINT) / 1000.0::DOUBLE AS total_duration_us
FROM v_detail WHERE v_detail.category IS NULL GROUP BY 1, 2, 3""")

SQL["window_metadata"] = with_views(V_SLICE, V_WINDOW, V_STARTED, """
SELECT w.trace_id, w.window_id, w.stage, w.start_ns, w.end_ns, (w.end_ns - w.start_ns) / 1000.0::DOUBLE AS window_duration_us,
  count(s.id) AS selected_event_count, coalesce(count_if(s.ts_ns + s.dur_ns > w.end_ns), 0) AS events_crossing_end,
  count(DISTINCT s.track_id) AS track_count, CAST(coalesce(sum(s.dur_ns), 0) AS BIGINT) / 1000.0::DOUBLE AS selected_total_duration_us,
  CASE WHEN count(s.id) = 0 THEN 'no_device_events' END AS error_code
FROM v_window w LEFT JOIN v_started s USING (trace_id, window_id)
GROUP BY w.trace_id, w.window_id, w.stage, w.start_ns, w.end_ns""")

SQL["carry_in"] = with_views(V_SLICE, V_WINDOW, """
SELECT w.trace_id, w.window_id, d.id AS event_id, d.ts_ns, d.dur_ns, d.ts_ns + d.dur_ns - w.start_ns AS carried_ns
FROM v_device d JOIN v_window w ON d.trace_id = w.trace_id AND d.ts_ns < w.start_ns AND d.ts_ns + d.dur_ns > w.start_ns""")

SQL["window_coverage"] = with_views(V_SLICE, V_WINDOW, V_STARTED, V_COVER, """
SELECT trace_id, window_id, window_ns / 1000.0::DOUBLE AS window_total_us, sum_ns / 1000.0::DOUBLE AS selected_duration_sum_us,
  sel_ns / 1000.0::DOUBLE AS selected_covered_us, cov_ns / 1000.0::DOUBLE AS device_covered_us,
  (sum_ns - sel_ns) / 1000.0::DOUBLE AS overlap_or_outside_deduction_us, n_carry AS carry_in_event_count,
  (cov_ns - sel_ns) / 1000.0::DOUBLE AS carry_in_extra_coverage_us, (cov_ns - sum_ns) / 1000.0::DOUBLE AS net_boundary_adjustment_us,
  (window_ns - cov_ns) / 1000.0::DOUBLE AS bubble_us,
  CAST(window_ns - cov_ns AS DOUBLE) / CAST(window_ns AS DOUBLE) * 100.0::DOUBLE AS bubble_pct,
  CAST(NULL AS VARCHAR) AS error_code
FROM v_cov""")

_ACCOUNT = ["busy_ns", "excluded_ns", "busy_ns + excluded_ns", "cov_ns - busy_ns - excluded_ns", "cov_ns",
            "window_ns - cov_ns", "window_ns"]
SQL["time_account"] = with_views(*ACCOUNTED, "v_rows AS (" + " UNION ALL ".join(
    f"SELECT trace_id, window_id, window_ns, {i} AS row_ord, {text(label)} AS item, {v} AS ns FROM v_busy"
    for i, (label, v) in enumerate(zip(TIME_ROWS, _ACCOUNT))) + ")", """
SELECT trace_id, window_id, row_ord, item, ns / 1000.0::DOUBLE AS total_us,
       CAST(ns AS DOUBLE) / CAST(window_ns AS DOUBLE) * 100.0::DOUBLE AS window_pct FROM v_rows""")

SQL["bubble_variants"] = with_views(*ACCOUNTED, """
v_span AS (
  SELECT trace_id, window_id, CAST(max(ts_ns + dur_ns) - min(ts_ns) - sum(dur_ns) AS BIGINT) AS gap_ns
  FROM v_started WHERE dur_ns > 0 GROUP BY ALL)""", """
SELECT trace_id, window_id, greatest(window_ns - busy_ns, 0) / 1000.0::DOUBLE AS window_minus_sum_us,
  greatest(coalesce(gap_ns, 0), 0) / 1000.0::DOUBLE AS span_minus_sum_us,
  (window_ns - cov_ns) / 1000.0::DOUBLE AS window_minus_coverage_us
FROM v_busy LEFT JOIN v_span USING (trace_id, window_id)""")

SQL["conservation_checks"] = with_views(*ACCOUNTED, """
SELECT trace_id, window_id, 'raw_equals_busy_plus_excluded' AS check_name, sum_ns AS lhs_ns, busy_ns + excluded_ns AS rhs_ns, sum_ns = busy_ns + excluded_ns AS ok FROM v_busy
UNION ALL SELECT trace_id, window_id, 'selected_covered_within_sum', sel_ns, sum_ns, sel_ns <= sum_ns FROM v_busy
UNION ALL SELECT trace_id, window_id, 'selected_covered_within_covered', sel_ns, cov_ns, sel_ns <= cov_ns FROM v_busy
UNION ALL SELECT trace_id, window_id, 'covered_within_window', cov_ns, window_ns, cov_ns <= window_ns FROM v_busy""")

# Launch sets per device event, by correlation id and by flow edge.
V_LINK = """
v_rtc AS (SELECT trace_id, correlation, list(id ORDER BY id) AS ids FROM v_runtime GROUP BY ALL),
v_fl AS (SELECT f.trace_id, f.slice_in, list(DISTINCT f.slice_out) AS ids FROM v_flow f JOIN v_runtime r ON f.trace_id = r.trace_id AND f.slice_out = r.id GROUP BY ALL),
v_sets AS (
  SELECT d.*, coalesce(c.ids, []) AS cs, coalesce(f.ids, []) AS fs
  FROM v_device d LEFT JOIN v_rtc c ON d.trace_id = c.trace_id AND d.correlation = c.correlation
  LEFT JOIN v_fl f ON d.trace_id = f.trace_id AND d.id = f.slice_in),
v_link AS (
  SELECT *, CASE WHEN len(cs) > 0 AND len(fs) > 0 THEN list_intersect(cs, fs) WHEN len(cs) > 0 THEN cs ELSE fs END AS cand,
    list_distinct(list_concat(cs, fs)) AS poss,
    CASE WHEN len(cs) > 0 AND len(fs) > 0 THEN CASE WHEN len(list_intersect(cs, fs)) > 0 THEN 'flow+correlation' ELSE 'conflicting-flow-correlation' END
         WHEN len(cs) > 0 THEN 'correlation' WHEN len(fs) > 0 THEN 'flow' ELSE 'unlinked' END AS basis
  FROM v_sets)"""
V_OWN = """
v_srt AS (
  SELECT s.trace_id, s.id AS scope_id, list(r.id) AS ids
  FROM v_step s JOIN v_runtime r ON s.trace_id = r.trace_id AND s.host_thread = r.host_thread
    AND r.ts_ns >= s.ts_ns AND r.ts_ns < s.ts_ns + s.dur_ns AND r.ts_ns + r.dur_ns <= s.ts_ns + s.dur_ns
  GROUP BY ALL),
v_pair AS (
  SELECT l.trace_id, s.scope_id, l.id, l.name, l.ts_ns, l.dur_ns, l.device, l.stream, l.correlation, l.basis, l.track_id, l.cand,
         len(l.cand) > 0 AND len(list_intersect(l.cand, s.ids)) = len(l.cand) AS owned
  FROM v_link l JOIN v_srt s ON l.trace_id = s.trace_id AND list_has_any(l.poss, s.ids)),
v_owned AS (SELECT * FROM v_pair WHERE owned)"""
V_BOUND = """
v_first AS (SELECT trace_id, scope_id, min(ts_ns) AS first_ts, count(*) AS n_owned FROM v_owned GROUP BY ALL),
v_fe AS (
  SELECT o.trace_id, o.scope_id, f.first_ts, f.n_owned, count(*) AS n_tied, arg_min(o.id, o.id) AS eid, arg_min(o.name, o.id) AS ename,
    arg_min(o.device, o.id) AS dev, arg_min(o.stream, o.id) AS stream, arg_min(o.correlation, o.id) AS corr, arg_min(o.basis, o.id) AS basis,
    bool_or(o.dur_ns < 0 OR (SELECT max(r.ts_ns) FROM v_runtime r WHERE r.trace_id = o.trace_id AND list_contains(o.cand, r.id)) > o.ts_ns) AS bad
  FROM v_owned o JOIN v_first f ON o.trace_id = f.trace_id AND o.scope_id = f.scope_id AND o.ts_ns = f.first_ts
  GROUP BY o.trace_id, o.scope_id, f.first_ts, f.n_owned),
v_unc AS (
  SELECT p.trace_id, p.scope_id, count(*) AS n_unc, bool_or(p.ts_ns <= f.first_ts) AS early
  FROM v_pair p LEFT JOIN v_first f USING (trace_id, scope_id) WHERE NOT p.owned GROUP BY ALL),
v_near AS (
  SELECT s.trace_id, s.id AS scope_id, count(*) AS n_near FROM v_step s JOIN v_first f ON s.trace_id = f.trace_id AND s.id = f.scope_id
  JOIN v_link l ON l.trace_id = s.trace_id AND l.basis = 'unlinked' AND l.ts_ns >= s.ts_ns AND l.ts_ns <= f.first_ts GROUP BY ALL),
v_boundary AS (
  SELECT s.trace_id, s.id AS scope_id, s.name AS annotation, s.ts_ns AS scope_start, s.ts_ns + s.dur_ns AS scope_end,
    e.eid AS first_event_id, e.ename AS first_event_name, e.first_ts AS first_ts_ns, e.dev AS device, e.stream, e.corr AS correlation,
    'same-host-thread-enclosure+' || e.basis AS association_basis, coalesce(e.n_tied, 0) AS tied_first_events,
    coalesce(e.n_owned, 0) AS owned_event_count, coalesce(u.n_unc, 0) AS ambiguous_event_count, coalesce(n.n_near, 0) AS unlinked_near_boundary,
    CASE WHEN e.eid IS NOT NULL THEN CASE WHEN n.n_near > 0 THEN 'first-confirmed-link; nearby-unlinked-events' ELSE 'confirmed-within-recorded-links' END END AS boundary_confidence,
    CASE WHEN e.eid IS NULL THEN 'no_owned_event' WHEN u.early THEN 'ambiguous_earlier_event' WHEN e.bad THEN 'unfinished_or_before_launch' END AS error_code
  FROM v_step s LEFT JOIN v_fe e ON s.trace_id = e.trace_id AND s.id = e.scope_id
  LEFT JOIN v_unc u ON s.trace_id = u.trace_id AND s.id = u.scope_id LEFT JOIN v_near n ON s.trace_id = n.trace_id AND s.id = n.scope_id)"""
LINKED = [V_SLICE, V_FLOW, V_LINK]
OWNED = [V_SLICE, V_FLOW, V_SLOT, V_STEP, V_LINK, V_OWN]
V_NTH = """
v_nth AS (
  SELECT trace_id, row_number() OVER p AS step, id, name, ts_ns, dur_ns, lead(id) OVER p AS next_id, lead(ts_ns) OVER p AS next_ts
  FROM v_step WHERE regexp_matches(name, '^execute_context_.*_generation_[1-9]\\d*\\(')
  WINDOW p AS (PARTITION BY trace_id ORDER BY ts_ns, id)),
v_pairs AS (
  SELECT *, CASE WHEN next_id IS NULL THEN 'no_next_annotation' WHEN ts_ns + dur_ns > next_ts THEN 'overlapping_annotations' END AS error_code
  FROM v_nth)"""

SQL["link_reconcile"] = with_views(*LINKED, """
SELECT trace_id, id AS event_id, basis, CAST(len(cand) AS BIGINT) AS candidate_count, CAST(len(poss) AS BIGINT) AS possible_count,
       list_min(cand) AS first_candidate, list_min(poss) AS first_possible FROM v_link""")

SQL["scope_runtimes"] = with_views(V_SLICE, """
SELECT s.trace_id, s.id AS scope_id, r.id AS runtime_id, r.ts_ns AS rt_ts, r.track_id = s.track_id AS on_track
FROM v_slice s JOIN v_runtime r ON s.trace_id = r.trace_id AND s.host_thread = r.host_thread
  AND r.ts_ns >= s.ts_ns AND r.ts_ns < s.ts_ns + s.dur_ns AND r.ts_ns + r.dur_ns <= s.ts_ns + s.dur_ns
WHERE s.category = 'cpu_op'""")

SQL["owned_events"] = with_views(*OWNED, """
SELECT trace_id, scope_id, id AS event_id, ts_ns, dur_ns, basis FROM v_owned""")

SQL["ambiguous_events"] = with_views(*OWNED, """
SELECT trace_id, scope_id, count_if(NOT owned) AS uncertain_count FROM v_pair GROUP BY ALL""")

SQL["step_boundary"] = with_views(*OWNED, V_BOUND, "SELECT * FROM v_boundary")

SQL["nth_step"] = with_views(V_SLICE, V_SLOT, V_STEP, V_NTH, """
SELECT trace_id, step, id, name, ts_ns, next_id, error_code FROM v_pairs""")

SQL["step_windows"] = with_views(*OWNED, V_BOUND, V_NTH, """
v_span AS (
  SELECT p.trace_id, p.step, p.id AS scope_id, p.name AS annotation, p.next_id AS next_scope_id, a.first_ts_ns AS a, b.first_ts_ns AS b,
    coalesce(p.error_code, a.error_code, b.error_code, CASE WHEN a.first_ts_ns >= b.first_ts_ns THEN 'reversed_boundaries' END) AS error_code
  FROM v_pairs p LEFT JOIN v_boundary a ON p.trace_id = a.trace_id AND p.id = a.scope_id
  LEFT JOIN v_boundary b ON p.trace_id = b.trace_id AND p.next_id = b.scope_id),
v_in AS (
  SELECT s.trace_id, s.scope_id, count(*) AS n, count_if(o.id IS NOT NULL) AS n_own
  FROM v_span s JOIN v_device d ON s.trace_id = d.trace_id AND d.ts_ns >= s.a AND d.ts_ns < s.b
  LEFT JOIN v_owned o ON o.trace_id = d.trace_id AND o.id = d.id AND o.scope_id = s.scope_id
  WHERE s.error_code IS NULL GROUP BY ALL),
v_cross AS (
  SELECT s.trace_id, s.scope_id, count(*) AS n FROM v_span s JOIN v_owned o USING (trace_id, scope_id)
  WHERE o.ts_ns + o.dur_ns > s.b GROUP BY ALL)""", """
SELECT s.trace_id, s.step, s.scope_id, s.annotation, s.next_scope_id, CASE WHEN error_code IS NULL THEN a END AS start_ns,
  CASE WHEN error_code IS NULL THEN b END AS end_ns, CASE WHEN error_code IS NULL THEN (b - a) / 1000.0::DOUBLE END AS period_us,
  CASE WHEN error_code IS NULL THEN coalesce(i.n_own, 0) END AS owned_in_window,
  CASE WHEN error_code IS NULL THEN coalesce(i.n - i.n_own, 0) END AS not_owned_in_window,
  CASE WHEN error_code IS NULL THEN coalesce(c.n, 0) END AS owned_crossing_end, error_code
FROM v_span s LEFT JOIN v_in i USING (trace_id, scope_id) LEFT JOIN v_cross c USING (trace_id, scope_id)""")

SQL["boundary_evidence"] = with_views(*OWNED, V_BOUND, V_WINDOW.replace(V_SLOT + ",", ""), """
v_origin AS (SELECT trace_id, min(ts_ns) AS t0 FROM v_slice GROUP BY ALL)""", """
SELECT trace_id, scope_id AS source_id, 'step' AS side, annotation, first_event_name AS event_name, (first_ts_ns - t0) / 1000.0::DOUBLE AS offset_us,
  device, association_basis, boundary_confidence, ambiguous_event_count, unlinked_near_boundary, error_code
FROM v_boundary JOIN v_origin USING (trace_id)
UNION ALL
SELECT trace_id, window_id, side, NULL, '用户给定时间', (edge - t0) / 1000.0::DOUBLE, NULL, 'user-time', 'caller-provided', 0, 0, NULL
FROM (SELECT trace_id, window_id, 'start' AS side, start_ns AS edge FROM v_window UNION ALL SELECT trace_id, window_id, 'end', end_ns FROM v_window)
JOIN v_origin USING (trace_id)""")

SQL["annotation_work"] = with_views(V_SLICE, V_SLOT, V_STEP, """
SELECT trace_id, id, name, CAST(m[1] AS BIGINT) AS prefill_count, CAST(m[2] AS BIGINT) AS prefill_tokens,
  CAST(m[3] AS BIGINT) AS decode_count, CAST(m[4] AS BIGINT) AS decode_tokens, CAST(m[1] AS BIGINT) > 0 AND CAST(m[3] AS BIGINT) > 0 AS mixed
FROM (SELECT *, string_split(regexp_replace(name, '^execute_context_(\\d+)\\((\\d+)\\)_generation_(\\d+)\\((\\d+)\\)', '\\1,\\2,\\3,\\4'), ',') AS m FROM v_step)""")


# Source attribution on the mapping half of each trace.
GRAPHISH = "(contains(lower({n}), 'graph') AND (contains(lower({n}), 'launch') OR contains(lower({n}), 'replay')))"
DULL = " OR ".join(f"contains(f.name, {text(w)})" for w in UNINFORMATIVE_FRAMES)
V_MAP = f"""
v_map AS (SELECT * FROM v_slice WHERE ts_ns < {MAPPING_END_NS} AND dur_ns > 0),
v_mk AS (SELECT m.* FROM v_map m JOIN v_class c USING (name) WHERE m.category IN ('kernel','gpu_memcpy','gpu_memset') AND c.category IS NOT NULL),
v_ml AS (SELECT * FROM v_map WHERE category = 'cuda_runtime'),
v_op AS (SELECT * FROM v_map WHERE category = 'cpu_op')"""
V_TIER = f"""
v_kl AS (
  SELECT k.trace_id, k.id AS kernel_id, l.tid, arg_max(l.id, l.ts_ns) AS launch_id
  FROM v_mk k JOIN v_ml l ON k.trace_id = l.trace_id AND k.correlation = l.correlation AND l.ts_ns <= k.ts_ns GROUP BY ALL),
v_kln AS (SELECT kl.trace_id, kl.kernel_id, l.id AS launch_id, l.ts_ns, l.external_id, l.tid, {GRAPHISH.format(n='l.name')} AS g
  FROM v_kl kl JOIN v_ml l ON kl.trace_id = l.trace_id AND kl.launch_id = l.id),
v_subj AS (
  SELECT k.trace_id, k.id AS kernel_id, k.name AS symbol, k.external_id AS ext, k.ts_ns, count(n.launch_id) AS n_launch, count_if(n.g) AS n_graph
  FROM v_mk k LEFT JOIN v_kln n ON k.trace_id = n.trace_id AND k.id = n.kernel_id GROUP BY ALL),
v_t0 AS (
  SELECT DISTINCT s.trace_id, s.kernel_id, o.id AS host_id, o.id AS op_id, 'external-id' AS basis
  FROM v_subj s JOIN v_op o ON s.trace_id = o.trace_id AND s.ext = o.external_id AND o.ts_ns <= s.ts_ns
  WHERE s.n_launch = 0 OR EXISTS (
    SELECT 1 FROM v_kln n WHERE n.trace_id = s.trace_id AND n.kernel_id = s.kernel_id AND NOT n.g AND n.tid = o.tid
      AND o.ts_ns <= n.ts_ns AND n.ts_ns < o.ts_ns + o.dur_ns)),
v_rest AS (SELECT n.* FROM v_kln n WHERE NOT n.g AND NOT EXISTS (SELECT 1 FROM v_t0 t WHERE t.trace_id = n.trace_id AND t.kernel_id = n.kernel_id)),
v_t1 AS (
  SELECT r.trace_id, r.kernel_id, r.launch_id AS host_id, o.id AS op_id, 'correlation+launch-external-id' AS basis
  FROM v_rest r JOIN v_op o ON r.trace_id = o.trace_id AND r.external_id = o.external_id AND r.tid = o.tid AND o.ts_ns <= r.ts_ns AND r.ts_ns < o.ts_ns + o.dur_ns),
v_in2 AS (
  SELECT r.trace_id, r.kernel_id, r.launch_id, o.id AS op_id, o.dur_ns, min(o.dur_ns) OVER (PARTITION BY r.trace_id, r.kernel_id, r.launch_id) AS best
  FROM v_rest r JOIN v_op o ON r.trace_id = o.trace_id AND r.tid = o.tid AND o.ts_ns <= r.ts_ns AND r.ts_ns < o.ts_ns + o.dur_ns
  WHERE NOT EXISTS (SELECT 1 FROM v_t1 t WHERE t.trace_id = r.trace_id AND t.kernel_id = r.kernel_id AND t.host_id = r.launch_id)),
v_t2 AS (SELECT trace_id, kernel_id, launch_id AS host_id, op_id, 'correlation+host-thread-enclosure' AS basis FROM v_in2 WHERE dur_ns = best),
v_t12 AS (SELECT * FROM v_t1 UNION ALL SELECT * FROM v_t2),
v_t3 AS (
  SELECT r.trace_id, r.kernel_id, r.launch_id AS host_id, NULL AS op_id, 'correlation+python-frame' AS basis FROM v_rest r
  WHERE NOT EXISTS (SELECT 1 FROM v_t12 t WHERE t.trace_id = r.trace_id AND t.kernel_id = r.kernel_id AND t.host_id = r.launch_id)),
v_host AS (SELECT * FROM v_t0 UNION ALL SELECT * FROM v_t12 UNION ALL SELECT * FROM v_t3),
v_loc AS (
  SELECT h.trace_id, h.id AS host_id, arg_min(f.name, (({DULL}), f.dur_ns, f.id)) AS python_location
  FROM v_map h JOIN v_map f ON f.category = 'python_function' AND h.trace_id = f.trace_id AND h.tid = f.tid
    AND f.ts_ns <= h.ts_ns + least(h.dur_ns // 2, 500) AND h.ts_ns + least(h.dur_ns // 2, 500) < f.ts_ns + f.dur_ns
  WHERE h.category IN ('cpu_op', 'cuda_runtime') GROUP BY ALL),
v_site AS (
  SELECT h.trace_id, h.kernel_id, o.name AS cpu_op, l.python_location, m.pid AS host_pid, m.tid AS host_tid, h.basis
  FROM v_host h JOIN v_map m ON h.trace_id = m.trace_id AND h.host_id = m.id
  LEFT JOIN v_op o ON h.trace_id = o.trace_id AND h.op_id = o.id LEFT JOIN v_loc l ON h.trace_id = l.trace_id AND h.host_id = l.host_id
  WHERE o.name IS NOT NULL OR l.python_location IS NOT NULL),
v_attr AS (
  SELECT DISTINCT s.trace_id, s.kernel_id, s.symbol, t.cpu_op, t.python_location, t.host_pid, t.host_tid, t.basis,
    CASE WHEN n_launch > 0 AND n_graph = n_launch THEN 'graph-launch-only' WHEN t.basis IS NULL THEN 'missing-host-link'
         WHEN n_graph > 0 THEN 'mixed-graph-and-kernel-launch-links' END AS reason
  FROM v_subj s LEFT JOIN v_site t USING (trace_id, kernel_id)),
v_sites AS (
  SELECT trace_id, symbol, cpu_op, python_location, host_pid, host_tid, count(DISTINCT kernel_id) AS observation_count,
    list_sort(list(DISTINCT basis)) AS attribution_basis FROM v_attr WHERE basis IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6),
v_symbol AS (
  SELECT trace_id, symbol, count(*) AS kernel_count, count_if(NOT found) AS unresolved_count,
    coalesce(list_sort(list(DISTINCT reason) FILTER (NOT found)), []) AS unresolved_reasons,
    coalesce(list_sort(list(DISTINCT reason) FILTER (found AND reason IS NOT NULL)), []) AS link_ambiguities
  FROM (SELECT trace_id, symbol, kernel_id, bool_or(basis IS NOT NULL) AS found, max(reason) AS reason FROM v_attr GROUP BY ALL) GROUP BY ALL)"""
# Balanced suffix: the depth seen from the end first returns to zero at the latest position where it does.
V_NORM = """
v_n0 AS (SELECT DISTINCT name, trim(regexp_replace(name, '0x[0-9a-fA-F]+', '0xADDR', 'g')) AS t0 FROM v_name),
v_n1 AS (SELECT name, CASE WHEN starts_with(t0, 'void ') THEN substr(t0, 6) ELSE t0 END AS t FROM v_n0),
v_n2 AS (
  SELECT name, t, u.i AS i, substr(t, u.i, 1) AS ch,
    len(replace(substr(t, u.i), ')', ')~')) - len(substr(t, u.i)) - (len(replace(substr(t, u.i), '(', '(~')) - len(substr(t, u.i))) AS depth
  FROM v_n1, unnest(range(1, CAST(length(t) AS BIGINT) + 1)) AS u(i) WHERE ends_with(t, ')')),
v_n3 AS (SELECT name, max(i) AS cut FROM v_n2 WHERE ch = '(' AND depth = 0 GROUP BY name),
v_norm AS (SELECT name, regexp_replace(CASE WHEN cut IS NOT NULL THEN substr(t, 1, cut - 1) ELSE t END, '\\s+', '', 'g') AS normalized FROM v_n1 LEFT JOIN v_n3 USING (name))"""
ATTRIBUTED = [V_SLICE, V_CLASS, V_MAP, V_TIER]
V_ATTACH = f"""
v_formal AS (
  SELECT s.trace_id, s.name AS kernel_name, c.category, count(*) AS call_count, CAST(sum(s.dur_ns) AS BIGINT) / 1000.0::DOUBLE AS total_duration_us
  FROM v_slice s JOIN v_class c USING (name)
  WHERE s.ts_ns >= {MAPPING_END_NS} AND s.dur_ns > 0 AND s.category IN ('kernel','gpu_memcpy','gpu_memset') AND c.category IS NOT NULL
  GROUP BY s.trace_id, s.name, c.category),
v_name AS (SELECT DISTINCT name FROM v_slice)""" + "," + V_NORM + """,
v_match AS (
  SELECT f.trace_id, f.kernel_name, y.symbol, 'name:exact' AS match_basis FROM v_formal f JOIN v_symbol y ON f.trace_id = y.trace_id AND f.kernel_name = y.symbol
  UNION ALL
  SELECT f.trace_id, f.kernel_name, y.symbol, 'name:normalized' FROM v_formal f JOIN v_norm a ON a.name = f.kernel_name
  JOIN v_symbol y ON f.trace_id = y.trace_id JOIN v_norm b ON b.name = y.symbol AND a.normalized = b.normalized
  WHERE NOT EXISTS (SELECT 1 FROM v_symbol z WHERE z.trace_id = f.trace_id AND z.symbol = f.kernel_name)),
v_cnt AS (SELECT trace_id, symbol, count(*) AS n_sites, count_if(cpu_op IS NULL OR python_location IS NULL) AS n_part FROM v_sites GROUP BY ALL),
v_got AS (
  SELECT m.trace_id, m.kernel_name, any_value(m.match_basis) AS match_basis, count(*) AS n_symbols, CAST(sum(coalesce(c.n_sites, 0)) AS BIGINT) AS n_sources,
    CAST(sum(coalesce(c.n_part, 0)) AS BIGINT) AS n_part, CAST(sum(y.unresolved_count) AS BIGINT) AS n_unresolved,
    list_sort(list_distinct(flatten(list(y.unresolved_reasons)))) AS unresolved_reasons, list_sort(list_distinct(flatten(list(y.link_ambiguities)))) AS link_ambiguities
  FROM v_match m JOIN v_symbol y ON m.trace_id = y.trace_id AND m.symbol = y.symbol LEFT JOIN v_cnt c ON m.trace_id = c.trace_id AND m.symbol = c.symbol GROUP BY ALL),
v_doubt AS (
  SELECT f.*, coalesce(g.match_basis, 'none') AS match_basis, coalesce(g.n_sources, 0) AS source_count, coalesce(g.n_unresolved, 0) AS mapping_unresolved_count,
    g.n_part, g.unresolved_reasons, list_concat(coalesce(g.link_ambiguities, []), list_filter([
      CASE WHEN n_symbols > 1 THEN 'multiple-mapping-symbols' END, CASE WHEN n_sources > 1 THEN 'multiple-source-sites' END,
      CASE WHEN n_unresolved > 0 AND n_sources > 0 THEN 'mapping-occurrences-without-source' END], lambda x: x IS NOT NULL)) AS doubts
  FROM v_formal f LEFT JOIN v_got g USING (trace_id, kernel_name)),
v_attached AS (
  SELECT trace_id, kernel_name, category, call_count, total_duration_us, match_basis, source_count, mapping_unresolved_count,
    CASE WHEN source_count = 0 THEN 'unresolved' WHEN len(doubts) > 0 THEN 'ambiguous' WHEN n_part > 0 THEN 'partial' ELSE 'mapped' END AS source_status,
    CASE WHEN match_basis = 'none' THEN list_concat(doubts, ['no-symbol-match']) WHEN source_count = 0 THEN list_concat(doubts, unresolved_reasons)
         WHEN len(doubts) > 0 THEN doubts WHEN n_part > 0 THEN ['incomplete-host-source'] ELSE doubts END AS ambiguity_reasons
  FROM v_doubt)"""

SQL["innermost_op"] = with_views(V_SLICE, """
v_in AS (
  SELECT r.trace_id, r.id AS host_id, o.id AS op_id, o.name AS op_name, o.dur_ns AS op_dur, min(o.dur_ns) OVER (PARTITION BY r.trace_id, r.id) AS best
  FROM v_runtime r JOIN v_slice o ON o.category = 'cpu_op' AND r.trace_id = o.trace_id AND r.host_thread = o.host_thread
    AND o.ts_ns <= r.ts_ns AND r.ts_ns < o.ts_ns + o.dur_ns)""", """
SELECT trace_id, host_id, op_id, op_name, op_dur FROM v_in WHERE op_dur = best""")

SQL["frame_stack"] = with_views(V_SLICE, f"""
v_fr AS (
  SELECT r.trace_id, r.id AS host_id, f.name, f.dur_ns, f.id, ({DULL}) AS dull,
    row_number() OVER (PARTITION BY r.trace_id, r.id ORDER BY f.dur_ns, f.id) AS depth
  FROM v_runtime r JOIN v_slice f ON f.category = 'python_function' AND r.trace_id = f.trace_id AND r.host_thread = f.host_thread
    AND f.ts_ns <= r.ts_ns + least(r.dur_ns // 2, 500) AND r.ts_ns + least(r.dur_ns // 2, 500) < f.ts_ns + f.dur_ns)""", """
SELECT trace_id, host_id, arg_min(name, (dull, dur_ns, id)) AS python_location, count(*) AS frame_count,
       list(name ORDER BY depth) FILTER (depth <= 8) AS python_stack FROM v_fr GROUP BY trace_id, host_id""")

SQL["asof_launch"] = with_views(V_SLICE, f"""
v_best AS (
  SELECT k.trace_id, k.id AS kernel_id, l.host_thread AS thread, arg_max(l.id, l.ts_ns) AS launch_id, max(l.ts_ns) AS launch_ts
  FROM v_device k JOIN v_runtime l ON k.trace_id = l.trace_id AND k.correlation = l.correlation AND l.ts_ns <= k.ts_ns GROUP BY ALL)""", f"""
SELECT b.*, {GRAPHISH.format(n='l.name')} AS is_graph FROM v_best b JOIN v_runtime l ON b.trace_id = l.trace_id AND b.launch_id = l.id""")

V_MAP_WHOLE = V_MAP.replace(f"ts_ns < {MAPPING_END_NS} AND ", "")
ATTRIBUTED_WHOLE = tuple(V_MAP_WHOLE if view is V_MAP else view for view in ATTRIBUTED)
SQL["attribution_tiers"] = with_views(*ATTRIBUTED_WHOLE, "SELECT * FROM v_attr")
SQL["symbol_sites"] = with_views(*ATTRIBUTED_WHOLE, "SELECT * FROM v_sites")
SQL["symbol_links"] = with_views(*ATTRIBUTED_WHOLE, "SELECT * FROM v_symbol")
SQL["cross_trace_sources"] = with_views(*ATTRIBUTED, V_ATTACH, "SELECT * FROM v_attached")
SQL["source_summary"] = with_views(*ATTRIBUTED, V_ATTACH, """
SELECT trace_id, source_status, count(*) AS symbol_count, round(sum(total_duration_us), 3) AS total_duration_us FROM v_attached GROUP BY ALL""")
SQL["graph_evidence"] = with_views(V_SLICE, V_CLASS, V_MAP_WHOLE, f"""
SELECT l.trace_id, l.name, count(*) AS launch_count FROM v_ml l WHERE {GRAPHISH.format(n='l.name')}
  AND EXISTS (SELECT 1 FROM v_mk k WHERE k.trace_id = l.trace_id AND k.correlation = l.correlation) GROUP BY ALL""")
SQL["normalized_symbols"] = with_views(V_SLICE, """
v_name AS (
  SELECT name FROM v_slice UNION SELECT CASE WHEN p_partkey % 2 = 0 THEN 'void ' ELSE '' END || replace(p_name, ' ', '_') || '<' || p_size || '>' || '(' || p_type || '(' || p_brand || ')' || ') ' FROM part)""",
    V_NORM, "SELECT name, normalized FROM v_norm")
SQL["config_diff"] = """
WITH lines AS (
  SELECT l_orderkey AS trace_id, 'line' || l_linenumber AS field, max(CAST(trunc(l_quantity) AS INT)) AS q, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
a AS (SELECT trace_id, field, CAST(q AS VARCHAR) AS mapping FROM lines WHERE NOT ends_with(CAST(q AS VARCHAR), '3')),
b AS (SELECT trace_id, field, CAST(q + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS formal FROM lines
      WHERE NOT ends_with(CAST(q + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR), '7'))
SELECT trace_id, field, mapping, formal FROM a FULL JOIN b USING (trace_id, field) WHERE mapping IS DISTINCT FROM formal"""

# Expert and delta-network context.
V_EXPERT = """
v_ex AS (
  SELECT r.trace_id, r.id AS runtime_id, arg_max(s.id, (s.ts_ns, s.id)) AS scope_id, arg_max(s.name, (s.ts_ns, s.id)) AS host_op
  FROM v_runtime r JOIN v_slice s ON s.category = 'cpu_op' AND regexp_matches(s.name, '(^|::)group_gemm_v2$', 'i')
    AND r.trace_id = s.trace_id AND r.host_thread = s.host_thread AND s.ts_ns <= r.ts_ns AND r.ts_ns < s.ts_ns + s.dur_ns
    AND r.ts_ns + r.dur_ns <= s.ts_ns + s.dur_ns
  GROUP BY ALL)"""
V_EXEV = """
v_poss AS (
  SELECT l.trace_id, l.id, count(*) AS n, count(e.scope_id) AS n_exp, min(e.scope_id) AS lo, max(e.scope_id) AS hi,
    max(r.ts_ns) AS last_ts, min(r.dur_ns) AS least_dur,
    count_if(list_contains(l.cand, r.id)) AS n_cand, count_if(list_contains(l.cand, r.id) AND e.scope_id IS NOT NULL) AS n_cand_exp
  FROM (SELECT *, unnest(poss) AS rid FROM v_link) l JOIN v_runtime r ON l.trace_id = r.trace_id AND l.rid = r.id
  LEFT JOIN v_ex e ON e.trace_id = r.trace_id AND e.runtime_id = r.id GROUP BY ALL),
v_exev AS (
  SELECT l.*, CASE WHEN p.n_cand > 0 AND p.n_cand_exp = p.n_cand THEN l.basis
    WHEN l.basis = 'conflicting-flow-correlation' AND p.n_exp = p.n AND p.lo = p.hi AND l.dur_ns >= 0 AND p.least_dur >= 0 AND p.last_ts <= l.ts_ns
    THEN 'conflicting-links-same-expert-scope' END AS expert_basis, coalesce(p.n_exp, 0) > 0 AS touches_expert
  FROM v_link l LEFT JOIN (SELECT trace_id, id, sum(n) n, sum(n_exp) n_exp, min(lo) lo, max(hi) hi, max(last_ts) last_ts, min(least_dur) least_dur,
    sum(n_cand) n_cand, sum(n_cand_exp) n_cand_exp FROM v_poss GROUP BY ALL) p USING (trace_id, id))"""
V_MOE = """
v_mg AS (
  SELECT w.trace_id, w.window_id, e.name, c.rule_id AS base_rule, count(*) AS n, CAST(sum(e.dur_ns) AS BIGINT) AS ns, count(e.expert_basis) AS nx,
    CAST(coalesce(sum(e.dur_ns) FILTER (e.expert_basis IS NOT NULL), 0) AS BIGINT) AS nsx, count_if(e.expert_basis IS NULL AND e.touches_expert) AS na,
    coalesce(count_if(e.expert_basis = 'conflicting-links-same-expert-scope'), 0) AS nc
  FROM v_exev e JOIN v_window w ON e.trace_id = w.trace_id AND e.ts_ns >= w.start_ns AND e.ts_ns < w.end_ns
  JOIN v_class c ON c.name = e.name AND c.category = 'gemm' GROUP BY ALL HAVING nx > 0 OR na > 0),
v_moe AS (
  SELECT trace_id, window_id, name, n AS observed_count, na AS ambiguous_count, nc AS resolved_conflict_count, 'expert' AS part, nx AS record_count,
    nsx AS duration_ns, 'group gemm' AS category, 'moe.teco.host_group_gemm' AS rule_id, 'high' AS confidence,
    CASE WHEN nc > 0 THEN 'ambiguous' ELSE 'confirmed-within-recorded-links' END AS launch_confidence FROM v_mg WHERE nx > 0
  UNION ALL
  SELECT trace_id, window_id, name, n, na, nc, 'residual', n - nx, ns - nsx, 'gemm', base_rule, 'unknown', NULL FROM v_mg WHERE nx < n)"""
V_GDN = """
v_core AS (
  SELECT DISTINCT r.trace_id, r.id FROM v_runtime r JOIN v_slice s ON s.category = 'cpu_op' AND s.name = 'vllm::qwen_gdn_attention_core'
    AND r.trace_id = s.trace_id AND r.host_thread = s.host_thread AND s.ts_ns <= r.ts_ns AND r.ts_ns < s.ts_ns + s.dur_ns AND r.ts_ns + r.dur_ns <= s.ts_ns + s.dur_ns),
v_conv AS (
  SELECT DISTINCT r.trace_id, r.id FROM v_runtime r JOIN v_core USING (trace_id, id) JOIN v_slice s ON s.category = 'cpu_op' AND ends_with(s.name, '::custom_causal_conv1d_update')
    AND r.trace_id = s.trace_id AND r.host_thread = s.host_thread AND s.ts_ns <= r.ts_ns AND r.ts_ns < s.ts_ns + s.dur_ns AND r.ts_ns + r.dur_ns <= s.ts_ns + s.dur_ns),
v_cand AS (
  SELECT l.trace_id, l.id, bool_and(c.id IS NOT NULL) AS core, bool_and(v.id IS NOT NULL) AS conv, bool_or(contains(lower(r.name), 'graphlaunch')) AS graph
  FROM (SELECT trace_id, id, unnest(cand) AS rid FROM v_link) l JOIN v_runtime r ON l.trace_id = r.trace_id AND l.rid = r.id
  LEFT JOIN v_core c ON c.trace_id = r.trace_id AND c.id = r.id LEFT JOIN v_conv v ON v.trace_id = r.trace_id AND v.id = r.id GROUP BY ALL),
v_pg AS (
  SELECT l.trace_id, l.id, bool_or(contains(lower(r.name), 'graphlaunch')) AS graph
  FROM (SELECT trace_id, id, unnest(poss) AS rid FROM v_link) l JOIN v_runtime r ON l.trace_id = r.trace_id AND l.rid = r.id GROUP BY ALL),
v_role AS (
  SELECT l.*, CASE WHEN c.id IS NULL OR c.graph OR NOT c.core THEN NULL WHEN c.conv THEN 'gdn_conv_update' WHEN contains(lower(l.name), 'fusednormargs') THEN NULL
    WHEN contains(lower(l.name), 'causal_conv1d') THEN 'gdn_conv_shared' WHEN l.category IN ('gpu_memcpy', 'gpu_memset') THEN 'gdn_memory' ELSE 'gdn_aux' END AS role,
    coalesce(p.graph, FALSE) AND (contains(lower(l.name), 'causal_conv1d') OR contains(lower(l.name), 'fusednormargs')) AS replayable
  FROM v_link l LEFT JOIN v_cand c USING (trace_id, id) LEFT JOIN v_pg p USING (trace_id, id)),
v_rec AS (
  SELECT DISTINCT w.trace_id, w.window_id FROM v_role e JOIN v_window w ON e.trace_id = w.trace_id AND e.ts_ns >= w.start_ns AND e.ts_ns < w.end_ns
  JOIN v_class c ON c.name = e.name AND c.category = 'GDN' AND starts_with(c.semantic_type, 'gdn_recurrent')),
v_gp AS (
  SELECT w.trace_id, w.window_id, e.name, c.category AS base_category, e.role, count(*) AS record_count, CAST(sum(e.dur_ns) AS BIGINT) AS duration_ns,
    count(*) FILTER (e.role IS NULL AND e.replayable AND r.trace_id IS NOT NULL) AS replay_count,
    CAST(coalesce(sum(e.dur_ns) FILTER (e.role IS NULL AND e.replayable AND r.trace_id IS NOT NULL), 0) AS BIGINT) AS replay_ns
  FROM v_role e JOIN v_window w ON e.trace_id = w.trace_id AND e.ts_ns >= w.start_ns AND e.ts_ns < w.end_ns
  JOIN v_class c ON c.name = e.name AND c.category IN ('其他elementwise', 'Triton', 'memcpy/memset')
  LEFT JOIN v_rec r ON r.trace_id = w.trace_id AND r.window_id = w.window_id
  WHERE r.trace_id IS NOT NULL OR EXISTS (SELECT 1 FROM v_slice s WHERE s.trace_id = e.trace_id AND s.name = 'vllm::qwen_gdn_attention_core')
  GROUP BY w.trace_id, w.window_id, e.name, c.category, e.role),
v_gdn AS (
  SELECT g.trace_id, g.window_id, g.name, g.role, g.record_count, g.duration_ns, CASE WHEN g.role IS NULL THEN g.base_category ELSE 'GDN' END AS category,
    replay_count, replay_ns
  FROM v_gp g WHERE EXISTS (SELECT 1 FROM v_gp h WHERE h.trace_id = g.trace_id AND h.window_id = g.window_id AND h.name = g.name AND (h.role IS NOT NULL OR h.replay_count > 0)))"""
V_PARTS = """
v_parts AS (
  SELECT d.trace_id, d.window_id, d.name, d.record_count, d.duration_ns, d.category, d.semantic_type, d.confidence, FALSE AS ctx, 0 AS replay_count FROM v_detail d
  WHERE NOT EXISTS (SELECT 1 FROM v_moe m WHERE m.trace_id = d.trace_id AND m.window_id = d.window_id AND m.name = d.name)
    AND NOT EXISTS (SELECT 1 FROM v_gdn g WHERE g.trace_id = d.trace_id AND g.window_id = d.window_id AND g.name = d.name)
  UNION ALL
  SELECT m.trace_id, m.window_id, m.name, m.record_count, m.duration_ns, m.category,
    CASE WHEN m.part = 'expert' THEN 'moe_expert_group_gemm' ELSE c.semantic_type END, m.confidence, TRUE, 0 FROM v_moe m JOIN v_class c USING (name)
  UNION ALL
  SELECT g.trace_id, g.window_id, g.name, g.record_count, g.duration_ns, g.category, coalesce(g.role, c.semantic_type),
    CASE WHEN g.role IS NULL THEN c.confidence ELSE 'high' END, FALSE, g.replay_count FROM v_gdn g JOIN v_class c USING (name))"""
CONTEXT = [V_SLICE, V_FLOW, V_LINK, V_WINDOW, V_CLASS, V_TOTALS, V_EXPERT, V_EXEV, V_MOE, V_GDN, V_PARTS]

SQL["expert_launches"] = with_views(V_SLICE, V_EXPERT, """
SELECT trace_id, runtime_id, scope_id, host_op, 'moe.teco.host_group_gemm' AS expert_rule FROM v_ex""")
SQL["expert_events"] = with_views(*LINKED, V_EXPERT, V_EXEV, """
SELECT trace_id, id AS event_id, basis, expert_basis, CASE WHEN expert_basis IS NOT NULL THEN 'moe.teco.host_group_gemm' END AS expert_rule, touches_expert FROM v_exev""")
SQL["moe_split"] = with_views(*LINKED, V_WINDOW, V_CLASS, V_EXPERT, V_EXEV, V_MOE, "SELECT * FROM v_moe")
SQL["launch_conflicts"] = with_views(*LINKED, V_EXPERT, V_EXEV, """
SELECT l.trace_id, l.id AS event_id, l.correlation, 'moe.teco.host_group_gemm' AS expert_rule, r.id AS launch_id, r.correlation AS launch_correlation, r.ts_ns AS launch_ts
FROM (SELECT *, unnest(poss) AS rid FROM v_exev WHERE expert_basis = 'conflicting-links-same-expert-scope') l JOIN v_runtime r ON l.trace_id = r.trace_id AND l.rid = r.id""")
SQL["gdn_roles"] = with_views(*LINKED, V_WINDOW, V_CLASS, V_GDN, "SELECT trace_id, id AS event_id, basis, role, replayable FROM v_role")
SQL["gdn_split"] = with_views(*LINKED, V_WINDOW, V_CLASS, V_GDN, "SELECT * FROM v_gdn")
SQL["context_summary"] = with_views(*CONTEXT, V_CATEGORY, """
v_win AS (
  SELECT p.trace_id, p.window_id, w.end_ns - w.start_ns AS window_ns, CAST(sum(CASE WHEN category IS NULL THEN 0 ELSE duration_ns END) AS BIGINT) AS busy_ns,
         bool_or(starts_with(semantic_type, 'moe_') OR ctx) AS moe
  FROM v_parts p JOIN v_window w USING (trace_id, window_id) GROUP BY ALL),
v_cat AS (
  SELECT trace_id, window_id, category, count(DISTINCT name) AS kinds, CAST(sum(record_count) AS BIGINT) AS n, CAST(sum(duration_ns) AS BIGINT) AS d
  FROM v_parts WHERE category IS NOT NULL GROUP BY ALL)""", f"""
SELECT w.trace_id, w.window_id, k.category_ord, k.category, coalesce(c.kinds, 0) AS kernel_kinds, coalesce(c.n, 0) AS record_count,
  coalesce(c.d, 0) / 1000.0::DOUBLE AS total_duration_us,
  CAST(coalesce(c.d, 0) AS DOUBLE) / nullif(CAST(w.busy_ns AS DOUBLE), 0) * 100.0::DOUBLE AS kernel_relative_pct,
  CAST(coalesce(c.d, 0) AS DOUBLE) / CAST(w.window_ns AS DOUBLE) * 100.0::DOUBLE AS window_absolute_pct
FROM v_win w CROSS JOIN v_category k LEFT JOIN v_cat c USING (trace_id, window_id, category)
WHERE k.category IN {DENSE} OR c.n > 0 OR (k.category = 'group gemm' AND w.moe)""")
SQL["downgraded_gemm"] = with_views(*CONTEXT, """
v_flag AS (SELECT trace_id, window_id FROM v_parts GROUP BY ALL
  HAVING bool_or(starts_with(semantic_type, 'moe_') OR ctx) AND NOT coalesce(bool_or(category = 'group gemm'), FALSE))""", """
SELECT trace_id, window_id, name, record_count, confidence AS name_rule_confidence, 'unknown' AS confidence, ['gemm', 'group gemm'] AS category_candidates
FROM v_parts JOIN v_flag USING (trace_id, window_id) WHERE category = 'gemm'""")


def _groups(groups: dict[str, list[str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN semantic_type IN ({', '.join(text(t) for t in ts)}) THEN {text(g)}" for g, ts in groups.items()) + f" ELSE {otherwise} END"


_G = GDN_COMPARISON_GROUPS
_MERGED = {k: v for k, v in _G.items() if k not in ("卷积后准备", "递推主计算")} | {GDN_DECODE_GROUP: _G["卷积后准备"] + _G["递推主计算"]}
_PRE = ", ".join(text(t) for t in ["gdn_conv", "gdn_gating_qk_fused", *_G["Chunk 主计算"]])
_DEC = ", ".join(text(t) for t in ["gdn_conv_update", *_G["递推主计算"]])
SQL["gdn_stage_summary"] = with_views(*CONTEXT, f"""
v_scope AS (
  SELECT p.trace_id, p.window_id, CASE WHEN p.window_id % 11 = 5 OR (pre AND dec) OR (w.stage = 'prefill' AND dec) OR (w.stage = 'decode' AND pre)
    THEN 'mixed-or-stage-mismatch' ELSE w.stage END AS scope
  FROM (SELECT trace_id, window_id, bool_or(semantic_type IN ({_PRE})) AS pre, bool_or(semantic_type IN ({_DEC})) AS dec FROM v_parts WHERE category = 'GDN' GROUP BY ALL) p
  JOIN v_window w USING (trace_id, window_id)),
v_rows AS (
  SELECT p.*, s.scope, CASE WHEN s.scope = 'decode' THEN {_groups(_MERGED, text(GDN_UNALIGNED_GROUP))} ELSE {_groups(_G, text(GDN_UNALIGNED_GROUP))} END AS grp
  FROM v_parts p JOIN v_scope s USING (trace_id, window_id) WHERE category = 'GDN'),
v_open AS (SELECT trace_id, window_id, count(DISTINCT name) FILTER (replay_count > 0) AS graph_candidates FROM v_parts GROUP BY ALL)""", """
SELECT trace_id, window_id, scope, grp AS "group", graph_candidates,
  max(CASE WHEN semantic_type = 'gdn_metadata' AND contains(name, 'gdn_prepare_cudagraph_impl') THEN 'gdn_prepare_cudagraph_impl'
           WHEN semantic_type = 'gdn_metadata' AND starts_with(name, 'Memcpy HtoD') THEN 'Memcpy HtoD' END) AS metadata_operator, CAST(sum(record_count) AS BIGINT) AS record_count, CAST(sum(duration_ns) AS BIGINT) / 1000.0::DOUBLE AS total_duration_us,
  count(DISTINCT name) AS kernel_kinds, list_sort(list(DISTINCT semantic_type)) AS semantic_types
FROM v_rows JOIN v_open USING (trace_id, window_id) GROUP BY 1, 2, 3, 4, 5""")
SQL["gdn_operators"] = with_views(*CONTEXT, f"""
SELECT trace_id, window_id, {_groups(GDN_OPERATOR_GROUPS, 'semantic_type')} AS label, CAST(sum(record_count) AS BIGINT) AS calls,
  CAST(sum(duration_ns) AS BIGINT) / 1000.0::DOUBLE AS total_duration_us, count(DISTINCT name) AS kernel_kinds
FROM v_parts WHERE category = 'GDN' GROUP BY 1, 2, 3""")

# Phases, keyword analysis and audit.
_GAP = 10 * 24 * HOUR_NS
V_STEPS = f"""
v_idx AS (
  SELECT trace_id, id, ts_ns, dur_ns, row_number() OVER p - 1 AS idx, count(*) OVER (PARTITION BY trace_id) AS n,
    lead(ts_ns) OVER p - (ts_ns + dur_ns) AS gap_after_ns, ts_ns - lag(ts_ns + dur_ns) OVER p AS gap_before_ns
  FROM v_forward WINDOW p AS (PARTITION BY trace_id ORDER BY ts_ns, id)),
v_gap AS (SELECT *, max(CASE WHEN gap_after_ns > {_GAP} THEN idx END) OVER (PARTITION BY trace_id) AS split FROM v_idx)"""
SQL["step_gaps"] = with_views(V_FORWARD, V_STEPS, f"""
SELECT trace_id, id, idx AS step, CASE WHEN split IS NULL AND idx = 0 THEN 'prefill' WHEN split IS NULL THEN 'decode-' || idx
  WHEN idx <= split THEN 'slow-' || idx ELSE 'fast-' || (idx - split - 1) END AS label, dur_ns, gap_after_ns,
  CASE WHEN gap_before_ns > {48 * HOUR_NS} THEN gap_before_ns / 1000000.0::DOUBLE END AS shown_gap_ms FROM v_gap""")
SQL["phase_split"] = with_views(V_FORWARD, V_STEPS, """
v_t AS (
  SELECT trace_id, any_value(split) AS split, any_value(n) AS n, any_value(n) - coalesce(any_value(split), -1) - 1 AS fast, min(ts_ns) AS t0,
    min(ts_ns) FILTER (idx = coalesce(split, -1) + 1) AS ff, min(ts_ns + dur_ns) FILTER (idx = 0) AS e0,
    min(ts_ns) FILTER (idx = coalesce(split, -1) + 3) AS nt, min(ts_ns + dur_ns) FILTER (idx = coalesce(split, -1) + 3) AS ne,
    min(ts_ns) FILTER (idx = coalesce(split, -1) + 4) AS a, min(ts_ns) FILTER (idx = n - 1) AS lt, min(ts_ns + dur_ns) FILTER (idx = n - 1) AS le
  FROM v_gap GROUP BY trace_id),
v_p AS (
  SELECT trace_id, n, split, fast, 'prefill' AS stage, t0 AS s, CASE WHEN split IS NULL THEN e0 ELSE ff END AS e FROM v_t
  UNION ALL SELECT trace_id, n, split, fast, 'decode', CASE WHEN split IS NULL THEN CASE WHEN n > 2 THEN nt ELSE lt END WHEN 2 < fast - 1 THEN nt ELSE lt END,
    CASE WHEN split IS NULL THEN CASE WHEN n > 2 THEN ne ELSE le END WHEN 2 < fast - 1 THEN a ELSE le END FROM v_t)""", """
SELECT trace_id, n AS step_count, CASE WHEN split IS NOT NULL THEN fast END AS fast_count, stage AS window_id, stage, s AS start_ns, e AS end_ns,
  CAST(NULL AS VARCHAR) AS error_code FROM v_p""")
SQL["phase_detail"] = with_views(V_SLICE, V_WINDOW, V_CLASS, f"""
v_tot AS (
  SELECT w.trace_id, w.window_id, s.name, count(*) AS n, CAST(sum(s.dur_ns) AS BIGINT) AS ns, min(w.end_ns - w.start_ns) AS window_ns
  FROM v_slice s JOIN v_window w ON s.trace_id = w.trace_id AND s.ts_ns >= w.start_ns AND s.ts_ns + s.dur_ns <= w.end_ns
  WHERE s.dur_ns > 0 AND (s.category IN ('kernel','gpu_memcpy','gpu_memset')
    OR (s.category = 'cpu_op' AND ({" OR ".join(f"contains(s.name, {text(k)})" for k in PHASE_KEYWORDS)}))) GROUP BY ALL)""", """
SELECT trace_id, window_id, name AS kernel_name, category, n AS call_count, ns / 1000.0::DOUBLE AS total_duration_us,
  CAST(ns AS DOUBLE) / CAST(sum(ns) OVER (PARTITION BY trace_id, window_id) AS DOUBLE) * 100.0::DOUBLE AS relative_pct,
  CAST(ns AS DOUBLE) / CAST(window_ns AS DOUBLE) * 100.0::DOUBLE AS absolute_pct
FROM v_tot JOIN v_class USING (name) WHERE category IS NOT NULL""")


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(name), {text(w.lower())})" for w in words) + ")"


_KEYWORD = "CASE WHEN starts_with(lower(name), 'triton_') THEN 'triton' " + " ".join(
    f"WHEN {_any(ws)} THEN {text(c)}" for c, ws in KEYWORD_CATEGORIES.items()) + " " + " ".join(
    f"WHEN contains(lower(name), 'kernel') AND {_any(ws)} THEN {text(c)}" for c, ws in KEYWORD_KERNEL_FALLBACK.items()) + " ELSE 'at::native' END"
V_KEY = f"""
v_kn AS (
  SELECT trace_id, name, count(*) AS n, CAST(sum(dur_ns) AS BIGINT) AS ns, min(ts_ns) AS lo, max(ts_ns + dur_ns) AS hi FROM v_device WHERE dur_ns <> 0 GROUP BY ALL),
v_kw AS (SELECT *, {_KEYWORD} AS category FROM v_kn),
v_kt AS (SELECT trace_id, CAST(sum(ns) AS BIGINT) AS kernel_ns, CAST(greatest(max(hi) - min(lo) - sum(ns), 0) AS BIGINT) AS idle_ns, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS calls FROM v_kw GROUP BY ALL),
v_ks AS (
  SELECT trace_id, category, count(*) AS operator_types, CAST(sum(n) AS BIGINT) AS call_count, CAST(sum(ns) AS BIGINT) AS ns FROM v_kw GROUP BY ALL
  UNION ALL SELECT trace_id, {text(BUBBLE_LABEL)}, 0, 0, idle_ns FROM v_kt WHERE idle_ns > 0
  UNION ALL SELECT trace_id, 'TOTAL', kinds, calls, kernel_ns + idle_ns FROM v_kt),
v_kr AS (
  SELECT trace_id, category, operator_types, call_count, ns / 1000.0::DOUBLE AS total_duration_us,
    CASE WHEN category = 'TOTAL' THEN 100.0::DOUBLE WHEN category <> {text(BUBBLE_LABEL)} THEN CAST(ns AS DOUBLE) / CAST(kernel_ns AS DOUBLE) * 100.0::DOUBLE END AS relative_pct,
    CASE WHEN category = 'TOTAL' THEN 100.0::DOUBLE ELSE CAST(ns AS DOUBLE) / CAST(kernel_ns + idle_ns AS DOUBLE) * 100.0::DOUBLE END AS absolute_pct
  FROM v_ks JOIN v_kt USING (trace_id)),
v_ko AS (
  SELECT trace_id, name, category, n AS call_count, ns / 1000.0::DOUBLE AS total_duration_us, CAST(ns AS DOUBLE) / n / 1000.0::DOUBLE AS avg_duration_us,
    CAST(ns AS DOUBLE) / CAST(kernel_ns AS DOUBLE) * 100.0::DOUBLE AS relative_pct FROM v_kw JOIN v_kt USING (trace_id))"""
SQL["keyword_operators"] = with_views(V_SLICE, V_KEY, "SELECT *, relative_pct AS absolute_pct FROM v_ko")
SQL["keyword_summary"] = with_views(V_SLICE, V_KEY, "SELECT * FROM v_kr")
_LIMIT = "CASE category " + " ".join(f"WHEN {text(c)} THEN {t}::DOUBLE" for c, t in ADVICE_THRESHOLDS.items()) + " END"
SQL["advice"] = with_views(V_SLICE, V_KEY, f"v_adv AS (SELECT trace_id, category, relative_pct, {_LIMIT} AS threshold_pct FROM v_kr WHERE relative_pct > {_LIMIT})", """
SELECT * FROM v_adv UNION ALL SELECT DISTINCT trace_id, 'balanced', NULL, NULL FROM v_kr WHERE trace_id NOT IN (SELECT trace_id FROM v_adv)""")
SQL["top_kernels"] = with_views(V_SLICE, V_KEY, """
SELECT trace_id, position, name, CASE WHEN length(name) > 50 THEN substr(name, 1, 50) || '...' ELSE name END AS display_name, call_count, total_duration_us
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY total_duration_us DESC, name) AS position FROM v_ko) WHERE position <= 10""")
SQL["event_categories"] = with_views(V_SLICE, "SELECT trace_id, category, count(*) AS event_count FROM v_slice GROUP BY ALL")
SQL["active_categories"] = f"SELECT trace_id, window_id, category_ord, category FROM ({SQL['category_summary']})"
SQL["classified_names"] = with_views(V_SLICE, V_CLASS, """
SELECT name, n AS record_count, category, reason, rule_id, semantic_type, confidence
FROM (SELECT name, count(*) AS n FROM v_slice GROUP BY name) JOIN v_class USING (name)""")
V_TABLE = f"""
v_table AS (
  SELECT l_returnflag AS table_id, ({text_list(DEVICE_NAMES)})[(p_partkey + p_size) % {len(DEVICE_NAMES)} + 1] AS name, count(*) AS record_count,
    CAST(sum(CAST(floor(l_extendedprice * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
V_AUDIT = V_TABLE + f""",
v_in AS (
  SELECT name, count(*) AS n, CAST(sum(dur_ns) AS BIGINT) / 1000.0::DOUBLE AS us FROM v_device GROUP BY name
  UNION ALL SELECT name, record_count, CAST(cents AS DOUBLE) FROM v_table),
v_audit AS (
  SELECT name, CAST(sum(n) AS BIGINT) AS record_count, sum(us) AS duration_us, {rule_case('name', 'category')} AS category, {rule_case('name', 'reason')} AS reason,
    {rule_case('name', 'rule_id')} AS rule_id, {rule_case('name', 'confidence')} AS confidence FROM v_in GROUP BY name)"""
SQL["audit_rollup"] = with_views(V_SLICE, V_AUDIT, """
SELECT category, reason, CAST(sum(record_count) AS BIGINT) AS record_count, round(sum(duration_us), 3) AS duration_us FROM v_audit GROUP BY ALL""")
SQL["audit_unknown"] = with_views(V_SLICE, V_AUDIT, """
SELECT name, record_count, round(duration_us, 3) AS duration_us, rule_id FROM v_audit WHERE rule_id = 'fallback' OR confidence = 'unknown'""")
SQL["reclassify_table"] = with_views(V_TABLE, f"""
v_rc AS (
  SELECT table_id, coalesce({rule_case('name', 'category')}, '非计算/排除') AS category, count(*) AS kinds, CAST(sum(record_count) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS c
  FROM v_table GROUP BY 1, 2)""", """
SELECT table_id, category, kinds AS kernel_kinds, n AS record_count, CAST(c AS DOUBLE) AS total_duration_us,
  CASE WHEN category <> '非计算/排除' THEN CAST(c AS DOUBLE) / CAST(sum(c) FILTER (category <> '非计算/排除') OVER (PARTITION BY table_id) AS DOUBLE) * 100.0::DOUBLE END AS kernel_relative_pct,
  CASE WHEN table_id <> 'R' THEN CAST(n AS DOUBLE) END AS window_absolute_pct FROM v_rc""")

# Comparison of even and odd ranks.
_PAIR = "CAST(CAST(substr(trace_id, 9, 1) AS BIGINT) // 2 AS VARCHAR) || '/' || window_id AS pair_id, CAST(substr(trace_id, 9, 1) AS BIGINT) AS rk"
V_BLOCK = f"""
v_gst AS (SELECT s.*, s."group" AS grp, w.stage FROM ({SQL['gdn_stage_summary']}) s JOIN v_window w USING (trace_id, window_id)),
v_odd AS (SELECT DISTINCT trace_id, window_id FROM v_gst WHERE scope = 'mixed-or-stage-mismatch'),
v_desc AS (
  SELECT {_PAIR}, trace_id, window_id, stage, window_id % 11 = 5 OR (trace_id, window_id) IN (SELECT (trace_id, window_id) FROM v_odd) AS mixed, CASE WHEN window_id % 7 = 0 THEN substr(trace_id, 9, 1) ELSE '0' END AS rank,
    CASE WHEN window_id % 5 <> 0 THEN CASE WHEN window_id % 11 = 5 THEN 3 ELSE 1 END + CASE WHEN window_id % 9 = 0 THEN CAST(substr(trace_id, 9, 1) AS BIGINT) ELSE 0 END END AS decode_count
  FROM v_window),
v_block AS (
  SELECT pair_id, list_filter([CASE WHEN NOT coalesce(l.stage = r.stage, FALSE) THEN {text(BLOCKER_STAGE)} END, CASE WHEN l.mixed OR r.mixed THEN {text(BLOCKER_MIXED)} END, CASE WHEN l.rank <> r.rank THEN {text(BLOCKER_RANK)} END,
    CASE WHEN l.trace_id IS NULL OR r.trace_id IS NULL THEN {text(BLOCKER_RULES)} END,
    CASE WHEN l.decode_count <> r.decode_count THEN {text(BLOCKER_WORK)} END], lambda x: x IS NOT NULL) AS blockers
  FROM (SELECT * FROM v_desc WHERE rk % 2 = 0) l FULL JOIN (SELECT * FROM v_desc WHERE rk % 2 = 1) r USING (pair_id))"""
_GATE = ", ".join(text(c) for c in GDN_CORE_STAGES)
V_GATE = f"""
v_side AS (SELECT {_PAIR}, min(scope) AS scope, min(stage) AS stage, list(DISTINCT grp) AS g, max(graph_candidates) AS open FROM v_gst GROUP BY ALL),
v_gate AS (
  SELECT pair_id, coalesce(l.open, 0) = 0 AND coalesce(r.open, 0) = 0 AND NOT list_contains(coalesce(l.g, []), {text(GDN_UNALIGNED_GROUP)})
    AND NOT list_contains(coalesce(r.g, []), {text(GDN_UNALIGNED_GROUP)})
    AND len(list_filter([{_GATE}], lambda c: list_contains(coalesce(l.g, []), c) <> list_contains(coalesce(r.g, []), c))) = 0 AS covered,
    covered AND coalesce(l.scope = l.stage AND r.scope = l.stage, FALSE) AS ok
  FROM (SELECT * FROM v_side WHERE rk % 2 = 0) l FULL JOIN (SELECT * FROM v_side WHERE rk % 2 = 1) r USING (pair_id))"""
_RATIO = "CASE WHEN left_us > 0 AND right_us > 0 THEN left_us / right_us END AS time_ratio, CASE WHEN {ok} THEN CASE WHEN right_us > 0 AND left_us > 0 THEN right_us / left_us END END AS observed_performance"
SQL["compare_blockers"] = with_views(V_SLICE, V_WINDOW, V_BLOCK, "SELECT * FROM v_block")
SQL["report_compare"] = with_views(V_SLICE, V_WINDOW, V_BLOCK, V_GATE, V_CATEGORY, f"v_sum AS (SELECT *, {_PAIR} FROM ({SQL['context_summary']}))", """
v_both AS (
  SELECT pair_id, category, coalesce(l.total_duration_us, 0) AS left_us, coalesce(r.total_duration_us, 0) AS right_us
  FROM (SELECT * FROM v_sum WHERE rk % 2 = 0) l FULL JOIN (SELECT * FROM v_sum WHERE rk % 2 = 1) r USING (pair_id, category))""",
    f"SELECT pair_id, category_ord, category, CASE WHEN category = 'GDN' AND NOT coalesce(covered, left_us = 0 AND right_us = 0) THEN '{GDN_CONFIRMED_SUBSET}' ELSE category END AS label, left_us, right_us, {_RATIO.format(ok="len(blockers) = 0 AND (category <> 'GDN' OR coalesce(ok, FALSE))")} FROM v_both JOIN v_block USING (pair_id) LEFT JOIN v_gate USING (pair_id) JOIN v_category USING (category)")
SQL["time_compare"] = with_views(V_SLICE, V_WINDOW, V_BLOCK, f"v_sum AS (SELECT *, {_PAIR} FROM ({SQL['time_account']}))", """
v_both AS (
  SELECT pair_id, row_ord, item, l.total_us AS left_us, r.total_us AS right_us
  FROM (SELECT * FROM v_sum WHERE rk % 2 = 0) l FULL JOIN (SELECT * FROM v_sum WHERE rk % 2 = 1) r USING (pair_id, row_ord, item))""",
    f"SELECT pair_id, row_ord, item, left_us, right_us, {_RATIO.format(ok='len(blockers) = 0 AND row_ord IN (0, 6)')} FROM v_both JOIN v_block USING (pair_id)")
_OPS = "CASE t " + " ".join(f"WHEN {text(t)} THEN {text(o)}" for t, o in GDN_COMPARISON_OPERATORS.items()) + " END"
_LABEL = (f"nullif(CASE WHEN grp = 'Chunk 主计算' THEN CASE WHEN list_contains(semantic_types, 'gdn_chunk_prefill') THEN 'FlashInfer chunk_gated_delta_rule' ELSE 'chunk_gated_delta_rule_fwd' END "
          f"WHEN grp = '{GDN_METADATA_GROUP}' AND metadata_operator IS NOT NULL THEN metadata_operator ELSE array_to_string(list_distinct(list_filter(list_transform(semantic_types, lambda t: {_OPS}), lambda o: o IS NOT NULL)), '、') END, '') AS ops")
SQL["gdn_compare"] = with_views(V_SLICE, V_WINDOW, V_BLOCK, f"""
v_lab AS (SELECT {_PAIR}, grp, total_duration_us, scope = stage AS aligned, {_LABEL} FROM v_gst)""", """
v_both AS (
  SELECT pair_id, grp, l.total_duration_us AS left_us, r.total_duration_us AS right_us, l.ops AS lo, r.ops AS ro, coalesce(l.aligned AND r.aligned, FALSE) AS aligned
  FROM (SELECT * FROM v_lab WHERE rk % 2 = 0) l FULL JOIN (SELECT * FROM v_lab WHERE rk % 2 = 1) r USING (pair_id, grp))""", f"""
SELECT pair_id, grp AS "group", CASE WHEN grp = 'Chunk 主计算' THEN '分块主计算' ELSE grp END || coalesce('（' || CASE WHEN lo <> ro THEN 'left: ' || lo || chr(10) || 'right: ' || ro ELSE coalesce(lo, ro) END || '）', '') AS label,
  left_us, right_us, {_RATIO.format(ok=f"len(blockers) = 0 AND aligned AND grp IN ({', '.join(text(c) for c in GDN_CORE_STAGES)})")}
FROM v_both JOIN v_block USING (pair_id)""")
SQL["context_rate"] = with_views(V_SLICE, V_WINDOW, f"""
v_tok AS (
  SELECT {_PAIR}, CASE WHEN window_id % 5 = 0 THEN CASE WHEN window_id % 11 = 5 THEN 64 ELSE 128 END END AS tokens, (end_ns - start_ns) / 1000.0::DOUBLE AS us
  FROM v_window)""", """
SELECT pair_id, l.tokens AS left_tokens, l.tokens * 1000000.0::DOUBLE / l.us AS left_tokens_per_s, r.tokens AS right_tokens, r.tokens * 1000000.0::DOUBLE / r.us AS right_tokens_per_s
FROM (SELECT * FROM v_tok WHERE rk % 2 = 0) l FULL JOIN (SELECT * FROM v_tok WHERE rk % 2 = 1) r USING (pair_id) WHERE l.tokens IS NOT NULL OR r.tokens IS NOT NULL""")
SQL["compare_checks"] = with_views(V_SLICE, V_WINDOW, f"""
v_one AS (
  SELECT trace_id, window_id, classes + coalesce(excluded, 0) AS whole, raw, selected_duration_sum_us AS sel, device_covered_us AS covered, window_total_us AS total, g.us AS rows_us, gdn, n, names
  FROM (SELECT trace_id, window_id, sum(total_duration_us) AS classes, coalesce(sum(total_duration_us) FILTER (category = 'GDN'), 0) AS gdn, count(*) AS n,
               count(DISTINCT category) AS names FROM ({SQL['context_summary']}) GROUP BY ALL) s
  LEFT JOIN (SELECT trace_id, window_id, sum(total_duration_us) AS excluded FROM ({SQL['excluded_markers']}) GROUP BY ALL) e USING (trace_id, window_id)
  LEFT JOIN (SELECT trace_id, window_id, sum(total_duration_us) AS raw FROM ({SQL['kernel_window_agg']}) GROUP BY ALL) k USING (trace_id, window_id)
  LEFT JOIN ({SQL['window_coverage']}) c USING (trace_id, window_id)
  LEFT JOIN (SELECT trace_id, window_id, sum(total_duration_us) AS us FROM ({SQL['gdn_stage_summary']}) GROUP BY ALL) g USING (trace_id, window_id)),
v_check AS (
  SELECT trace_id, window_id, unnest([
    {{'c': 'classes_equal_kernels', 'a': whole, 'b': raw, 'ok': abs(whole - raw) <= greatest(1e-6, raw * 1e-10)}},
    {{'c': 'classes_equal_selected', 'a': whole, 'b': sel, 'ok': abs(whole - sel) <= greatest(1e-6, sel * 1e-10)}},
    {{'c': 'coverage_within_window', 'a': covered, 'b': total, 'ok': covered >= 0 AND total > 0 AND covered <= total}},
    {{'c': 'gdn_rows_equal_category', 'a': rows_us, 'b': gdn, 'ok': rows_us IS NULL OR abs(gdn - rows_us) <= greatest(1e-6, rows_us * 1e-10)}},
    {{'c': 'one_row_per_category', 'a': CAST(n AS DOUBLE), 'b': CAST(names AS DOUBLE), 'ok': n = names}}]) AS k FROM v_one)""", """
SELECT CASE WHEN CAST(substr(trace_id, 9, 1) AS BIGINT) % 2 = 0 THEN 'left' ELSE 'right' END AS side, trace_id, window_id, k.c AS check_name,
  round(CAST(k.a AS DOUBLE), 3) AS lhs, round(CAST(k.b AS DOUBLE), 3) AS rhs, k.ok AS ok FROM v_check""")
SQL["rank_blocks"] = f"""
SELECT trace_id, window_id, category, record_count, CAST(NULL AS VARCHAR) AS error_code,
  CASE WHEN regexp_matches(trace_id || '.json.gz', '_rank(\\d+)[._]') THEN CAST(substr(trace_id, 9, 1) AS INT) END AS rank
FROM ({SQL['category_summary']})"""

# Benchmark logs and occupancy.
V_GEMM = """
v_cmd AS (
  SELECT p_partkey AS line, p_size, p_partkey % 3 = 0 AS t, p_partkey % 4 + 1 AS n FROM part WHERE p_partkey % 7 <> 3),
v_case AS (
  SELECT line, CAST(p_size * 128 AS VARCHAR) AS m, CAST(n AS VARCHAR) AS n, CAST(p_size * 64 AS VARCHAR) AS k, CASE WHEN t THEN 'T' ELSE 'N' END AS transA FROM v_cmd),
v_res AS (
  SELECT l_partkey AS line, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'optimized' END AS variant, max(l_linenumber) AS top,
    CAST(sum(CAST(floor(l_extendedprice * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) AS us, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) * 1000 AS DOUBLE) AS gflops
  FROM lineitem GROUP BY 1, 2),
v_kern AS (SELECT line, variant, CASE WHEN top = 7 THEN NULL WHEN top % 2 = 0 THEN 'Cijk_Alik_Bljk_MT' || top || 'x16' ELSE 'Alik_' || top END AS kernel, gflops, us FROM v_res),
v_gc AS (
  SELECT c.*, CASE WHEN transA = 'T' THEN 'TransA=T, TransB=N' ELSE 'TransA=N, TransB=N, n=' || n END AS case_group,
    b.kernel AS baseline_kernel, b.gflops AS baseline_gflops, b.us AS baseline_us, o.kernel AS optimized_kernel, o.gflops AS optimized_gflops, o.us AS optimized_us,
    floor(o.gflops / nullif(b.gflops, 0) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS gflops_pct,
    floor(b.us / nullif(o.us, 0) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS us_pct
  FROM v_case c LEFT JOIN v_kern b ON b.line = c.line AND b.variant = 'baseline' LEFT JOIN v_kern o ON o.line = c.line AND o.variant = 'optimized')"""
SQL["gemm_params"] = with_views(V_GEMM, """
SELECT c.line, m, c.n, k, transA, 'N' AS transB, '1' AS alpha, '0' AS beta, m AS lda, NULL AS ldb, NULL AS ldc, NULL AS ldd,
  'bf16_r' AS a_type, 'bf16_r' AS b_type, 'bf16_r' AS c_type, 'bf16_r' AS d_type, 'f32_r' AS compute_type FROM v_case c""")
SQL["gemm_results"] = with_views(V_GEMM, "SELECT line, variant, kernel, gflops, us FROM v_kern")
SQL["gemm_compare"] = with_views(V_GEMM, "SELECT * FROM v_gc")
SQL["gemm_stats"] = with_views(V_GEMM, """
SELECT case_group, count(*) AS case_count, CAST(sum(CAST(round(gflops_pct * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS mean_pct, max(gflops_pct) AS max_pct,
  min(gflops_pct) AS min_pct, count_if(gflops_pct > 100) AS improved, count_if(gflops_pct < 100) AS regressed, count_if(gflops_pct = 100) AS unchanged
FROM v_gc WHERE gflops_pct IS NOT NULL GROUP BY case_group""")
V_OCC = """
v_card AS (
  SELECT p_size AS node, p_partkey AS card, '0000:' || p_partkey AS bus, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size * 10 END AS used, p_partkey % 3 * 40 AS load FROM part),
v_own AS (
  SELECT p_size AS node, p_partkey AS card, o_orderkey AS pid, CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE 'worker_' || o_orderstatus END AS process,
    CAST(o_orderkey % 512 AS VARCHAR) AS process_mem, CASE WHEN o_totalprice >= 400000 THEN '?' WHEN o_orderstatus = 'F' THEN 'serve_' || (o_orderkey % 5)
    WHEN o_orderstatus = 'O' THEN '宿主机进程' ELSE '（进程已退出）' END AS owner
  FROM orders JOIN part ON o_custkey = p_partkey)"""
SQL["card_owners"] = with_views(V_OCC, "SELECT * FROM v_own")
SQL["card_state"] = with_views(V_OCC, """
SELECT c.node, c.card, c.bus, c.used || 'MB' AS mem_used, '32768MB' AS mem_total, c.load || '%' AS util, count(DISTINCT o.pid) AS process_count,
  string_agg(DISTINCT o.owner, '、' ORDER BY o.owner) AS owners, CASE WHEN count(o.pid) > 0 THEN 'busy' WHEN c.used > 0 THEN 'stuck' ELSE 'idle' END AS state
FROM v_card c LEFT JOIN v_own o USING (node, card) GROUP BY c.node, c.card, c.bus, c.used, c.load""")
SQL["idle_cards"] = with_views(V_OCC, "SELECT node, card, bus FROM v_card WHERE used = 0 AND load = 0")

# Phase annotations and dump cases.
SQL["phase_fields"] = """
SELECT 'run_rank' || (o_custkey % 4) AS trace_id, o_orderkey AS id,
  'PHASE_GRAPH step=' || o_orderkey || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ' phase=' || lower(o_orderstatus) END || ' tokens=' || o_custkey ||
  CASE WHEN o_orderkey % 2 = 0 THEN ' padded=' || (o_custkey + 1) ELSE '' END || ' mode=' || substr(o_orderpriority, 3) || ' computed=[' || o_custkey || ',' || o_orderkey || '] prompt=[' || o_orderkey || ']' AS name,
  o_orderkey AS step, CASE WHEN o_orderkey % 13 <> 0 THEN lower(o_orderstatus) END AS phase, o_custkey AS tokens,
  string_split(substr(o_orderpriority, 3), ' ')[1] AS mode, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS padded,
  [o_custkey, o_orderkey] AS computed, [o_orderkey] AS prompt, CASE WHEN o_orderkey % 13 = 0 THEN 'missing_fields' END AS error_code
FROM orders"""
SQL["launch_counts"] = f"""
WITH s AS (SELECT 'run_rank' || (o_custkey % 4) AS trace_id, o_orderkey AS scope_id, epoch_us(o_orderdate) * 1000 AS t, o_custkey % 7 AS tid FROM orders),
l AS (SELECT 'run_rank' || (l_partkey % 4) AS trace_id, epoch_us(l_shipdate) * 1000 AS t, l_orderkey % 7 AS tid FROM lineitem WHERE l_suppkey % 5 IN (0, 1, 3))
SELECT s.trace_id, s.scope_id, count(l.t) AS graph_launches
FROM s LEFT JOIN l ON s.trace_id = l.trace_id AND s.tid = l.tid AND l.t >= s.t AND l.t < s.t + {120 * HOUR_NS} GROUP BY ALL"""
V_DUMP = """
v_dump AS (
  SELECT l_returnflag || l_linestatus AS operator, sha256(CAST(trunc(l_quantity) AS INT) || '/' || CAST(round(l_discount * 100) AS INT) || '/' || CAST(round(l_tax * 100) AS INT)) AS content_hash,
    min(l_orderkey * 8 + l_linenumber) AS representative, count(*) AS copies
  FROM lineitem WHERE epoch_us(l_shipdate) * 1000 BETWEEN 900000000000000000 AND 950000000000000000 GROUP BY 1, 2)"""
SQL["dump_dedup"] = with_views(V_DUMP, "SELECT * FROM v_dump")
SQL["dump_counts"] = with_views(V_DUMP, "SELECT operator, CAST(sum(copies) AS BIGINT) AS before_count, count(*) AS after_count FROM v_dump GROUP BY operator")

# Ingest.
SQL["trace_slices"] = """
SELECT 'run_rank' || (user_id % 5) || '.json' AS trace_id, event_id AS id, event_type || '<' || user_id || '>' AS name,
  CASE WHEN event_type = 'signup' THEN 'cuda_runtime' ELSE event_type END AS category, epoch_us(ts) * 1000 AS ts_ns,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(CAST(value AS DECIMAL(22,3)) * 1000 AS BIGINT) END AS dur_ns,
  (user_id % 3) || '/' || CASE WHEN user_id % 7 = 0 THEN 'None' ELSE CAST(user_id % 7 AS VARCHAR) END AS host_thread,
  regexp_extract(props, '([0-9]+)', 1) AS correlation, CAST(user_id AS VARCHAR) AS external_id, CAST(user_id % 4 AS VARCHAR) AS device, event_type AS stream
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0"""

SQL["document_events"] = r"""
SELECT splits, 'run_rank' || (user_id % 5) || '.json' AS trace_id, row_number() OVER (PARTITION BY splits, user_id % 5 ORDER BY event_id) - 1 AS ord,
  CASE WHEN event_id % 11 = 0 THEN 'C' WHEN event_id % 13 = 0 THEN 's' WHEN event_id % 17 = 0 THEN NULL ELSE 'X' END AS ph,
  CASE WHEN event_type = 'signup' THEN 'cuda_runtime' ELSE event_type END AS cat,
  event_type || '<' || user_id || '>\"},{"' || CASE WHEN event_type = 'signup' THEN 'cuda_runtime' ELSE event_type END || '\\' AS name,
  CAST(user_id % 3 AS VARCHAR) AS pid, CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 7 AS VARCHAR) END AS tid, epoch_us(ts) * 1000 AS ts_ns,
  CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(value AS DECIMAL(22,3)) * 1000 AS BIGINT) END AS dur_ns,
  CASE WHEN event_id % 13 = 0 THEN CAST(user_id AS VARCHAR) END AS flow_id, event_type AS stream
FROM events, (VALUES (1), (8), (64)) AS s(splits)"""

SQL["kernel_table_rows"] = with_views(V_TABLE, "v_row AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY name) AS n FROM v_table)", """
SELECT table_id, 1 + n + n // 3 AS source_row, CASE WHEN n % 11 <> 0 THEN name END AS name, CASE WHEN n % 7 <> 0 THEN record_count END AS record_count,
  CAST(cents AS DOUBLE) AS total_duration_us, CASE WHEN n % 11 = 0 THEN 'missing_name' WHEN n % 7 = 0 THEN 'invalid_number' END AS error_code
FROM v_row""")

_US = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || CAST(abs({0}) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs({0}) % 1000 AS VARCHAR), 3, '0')"
SQL["window_requests"] = with_views(V_SLICE, V_WINDOW, f"""
v_bound AS (SELECT trace_id, min(ts_ns) AS lo, max(ts_ns + greatest(dur_ns, 0)) AS hi FROM v_slice GROUP BY trace_id),
v_rel AS (
  SELECT DISTINCT CASE WHEN window_id % 13 = 6 THEN 'run_rank9' ELSE w.trace_id END AS trace_id, window_id, stage,
    CASE WHEN window_id % 7 = 3 THEN 'NaN' WHEN window_id % 7 = 5 THEN {_US.format('(end_ns - lo)')} ELSE {_US.format('(start_ns - lo)')} END AS start_us,
    CASE WHEN window_id % 7 = 5 THEN {_US.format('(start_ns - lo)')} ELSE {_US.format('(end_ns - lo)')} END AS end_us
  FROM v_window w JOIN v_bound b USING (trace_id)),
v_asked AS (
  SELECT r.*, b.lo, CASE WHEN start_us <> 'NaN' AND start_us NOT LIKE '-%' THEN CAST(CAST(start_us AS DECIMAL(30,3)) * 1000 AS BIGINT) END AS a,
    CASE WHEN end_us NOT LIKE '-%' THEN CAST(CAST(end_us AS DECIMAL(30,3)) * 1000 AS BIGINT) END AS b, b.hi
  FROM (SELECT trace_id, window_id, stage, start_us, end_us FROM v_rel) r LEFT JOIN v_bound b USING (trace_id)),
v_judged AS (
  SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'invalid_time' WHEN a >= b THEN 'empty_window' WHEN lo IS NULL THEN 'unknown_trace' WHEN b > hi - lo THEN 'beyond_trace_bounds' END AS e
  FROM v_asked),
v_found AS (
  SELECT j.trace_id, j.window_id, count(*) AS n, count(*) FILTER (d.ts_ns + d.dur_ns > lo + b) AS crossing, list_sort(list(DISTINCT d.track_id)) AS tracks
  FROM v_judged j JOIN v_device d ON d.trace_id = j.trace_id AND d.ts_ns >= lo + a AND d.ts_ns < lo + b WHERE e IS NULL GROUP BY ALL)""", """
SELECT j.trace_id, j.window_id, stage, start_us, end_us, lo AS trace_start_ns, CASE WHEN e IS NULL THEN a END AS start_offset_ns, CASE WHEN e IS NULL THEN b END AS end_offset_ns,
  CASE WHEN e IS NULL THEN lo + a END AS start_ns, CASE WHEN e IS NULL THEN lo + b END AS end_ns, n AS selected_event_count, crossing AS events_crossing_end, tracks AS track_ids,
  coalesce(e, CASE WHEN n IS NULL THEN 'no_device_events' END) AS error_code
FROM v_judged j LEFT JOIN v_found f USING (trace_id, window_id)""")
