"""Comparison of two classified windows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (BLOCKER_MIXED, BLOCKER_RANK, BLOCKER_RULES, BLOCKER_STAGE, BLOCKER_UNVERIFIED, BLOCKER_WORK, GDN_CONFIRMED_SUBSET, GDN_METADATA_GROUP,
                            GDN_COMPARISON_OPERATORS, GDN_CORE_STAGES, GDN_UNALIGNED_GROUP, TIME_ROWS)
from .classify import category_rank, sql_text

WORK = ["prefill_tokens", "mixed_count", "mixed_generation_tokens", "decode_count", "decode_tokens"]


def blockers(left: DataFrame, right: DataFrame, verified: bool) -> DataFrame:
    """Reasons why a pair's performance must not be compared.

    Sides hold ``pair_id, stage, mixed, rank, rules_sha256`` and the work counts; a count on one side
    only does not block. A pair without one of its sides keeps its row and is blocked.
    """
    columns = ["stage", "mixed", "rank", "rules_sha256", *WORK]
    both = left.select("pair_id", *[F.col(c).alias(f"l_{c}") for c in columns]).join(
        right.select("pair_id", *[F.col(c).alias(f"r_{c}") for c in columns]), "pair_id", "full")
    work = " OR ".join(f"coalesce(l_{c} <> r_{c}, FALSE)" for c in WORK)
    checks = [
        ("NOT coalesce(l_stage = r_stage AND l_stage IN ('prefill', 'decode'), FALSE)", BLOCKER_STAGE),
        ("coalesce(l_mixed, FALSE) OR coalesce(r_mixed, FALSE)", BLOCKER_MIXED),
        ("coalesce(l_rank <> r_rank, FALSE)", BLOCKER_RANK),
        ("NOT coalesce(l_rules_sha256 = r_rules_sha256, FALSE)", BLOCKER_RULES),
        (work, BLOCKER_WORK), (str(not verified), BLOCKER_UNVERIFIED)]
    items = ", ".join(f"IF({condition}, {sql_text(label)}, NULL)" for condition, label in checks)
    return both.selectExpr("pair_id", f"filter(array({items}), x -> x IS NOT NULL) AS blockers")


def _ratios(allowed: str) -> list[str]:
    """Time ratio left/right, and its inverse as observed performance where allowed; NULL without two positive times."""
    ratio = "IF({a} > 0 AND {b} > 0, {a} / {b}, NULL)"
    return [f"{ratio.format(a='left_us', b='right_us')} AS time_ratio",
            f"IF({allowed}, {ratio.format(a='right_us', b='left_us')}, NULL) AS observed_performance"]


def mixed_by_scope(windows: DataFrame, stages: DataFrame) -> DataFrame:
    """Window descriptors whose ``mixed`` is also true where the delta-network stages do not fit the window's stage."""
    scopes = stages.groupBy("trace_id", "window_id").agg(F.expr("bool_or(scope = 'mixed-or-stage-mismatch') AS _odd"))
    odd = F.coalesce(F.col("mixed"), F.lit(False)) | F.coalesce(F.col("_odd"), F.lit(False))
    return windows.join(scopes, ["trace_id", "window_id"], "left").withColumn("mixed", odd).drop("_odd")


def gdn_comparable(left: DataFrame, right: DataFrame) -> DataFrame:
    """``pair_id, gdn_covered, gdn_comparable``: covered if neither side has open replay candidates or unaligned rows and both have the same
    core stages; comparable if both sides are also wholly in the left side's stage.

    Sides hold ``pair_id, stage, scope, group, graph_candidates``. Pairs without rows on one side are judged by the other.
    """
    core = ", ".join(sql_text(c) for c in GDN_CORE_STAGES)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("pair_id").agg(F.collect_set("group").alias(f"{tag}_groups"), F.min("scope").alias(f"{tag}_scope"),
                                         F.min("stage").alias(f"{tag}_stage"), F.max("graph_candidates").alias(f"{tag}_open"))

    unaligned = sql_text(GDN_UNALIGNED_GROUP)
    listed = [f"coalesce({tag}_groups, CAST(array() AS ARRAY<STRING>)) AS {tag}_groups" for tag in "lr"]
    return side(left, "l").join(side(right, "r"), "pair_id", "full").selectExpr("* EXCEPT (l_groups, r_groups)", *listed).selectExpr(
        "*", f"coalesce(l_open, 0) = 0 AND coalesce(r_open, 0) = 0 AND NOT array_contains(l_groups, {unaligned}) AND NOT array_contains(r_groups, {unaligned}) "
        f"AND forall(array({core}), c -> array_contains(l_groups, c) = array_contains(r_groups, c)) AS gdn_covered").selectExpr(
        "pair_id", "gdn_covered", "gdn_covered AND coalesce(l_scope = l_stage AND r_scope = l_stage, FALSE) AS gdn_comparable")


def compare_categories(left: DataFrame, right: DataFrame, blocked: DataFrame, gdn: DataFrame) -> DataFrame:
    """Category times of both sides ``(pair_id, category, total_duration_us)``, allocations applied; a category absent on a side is 0.

    ``gdn`` as from :func:`gdn_comparable`; pairs it does not confirm show no performance for that category, and its label says so where
    only a subset is covered.
    """
    both = left.selectExpr("pair_id", "category", "total_duration_us AS l").join(
        right.selectExpr("pair_id", "category", "total_duration_us AS r"), ["pair_id", "category"], "full").selectExpr(
        "pair_id", "category", "coalesce(l, 0D) AS left_us", "coalesce(r, 0D) AS right_us")
    return both.join(blocked, "pair_id").join(gdn, "pair_id", "left").withColumn("category_ord", category_rank("category")).selectExpr(
        "pair_id", "category_ord", "category",
        f"IF(category = 'GDN' AND NOT coalesce(gdn_covered, left_us = 0 AND right_us = 0), {sql_text(GDN_CONFIRMED_SUBSET)}, category) AS label", "left_us", "right_us",
        *_ratios("size(blockers) = 0 AND (category <> 'GDN' OR coalesce(gdn_comparable, FALSE))"))


def compare_time(left: DataFrame, right: DataFrame, blocked: DataFrame) -> DataFrame:
    """Time-account rows of both sides ``(pair_id, row_ord, item, total_us)``; performance only for totals."""
    both = left.selectExpr("pair_id", "row_ord", "item", "total_us AS left_us").join(
        right.selectExpr("pair_id", "row_ord", "item", "total_us AS right_us"), ["pair_id", "row_ord", "item"], "full")
    return both.join(blocked, "pair_id").selectExpr(
        "pair_id", "row_ord", "item", "left_us", "right_us",
        *_ratios(f"size(blockers) = 0 AND row_ord IN (0, {len(TIME_ROWS) - 1})"))


def compare_gdn(left: DataFrame, right: DataFrame, blocked: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Gated-delta-network groups of both sides with a label that names each side's operators.

    Sides hold ``pair_id, stage, scope, group, total_duration_us, semantic_types, metadata_operator``. Performance is shown
    for core stages of windows whose scope is their stage.
    """
    known = ", ".join(f"'{t}', {sql_text(o)}" for t, o in GDN_COMPARISON_OPERATORS.items())
    chunk = ("IF(array_contains({s}, 'gdn_chunk_prefill'), 'FlashInfer chunk_gated_delta_rule', 'chunk_gated_delta_rule_fwd')")
    listed = f"array_join(array_distinct(filter(transform({{s}}, t -> try_element_at(map({known}), t)), o -> o IS NOT NULL)), '、')"

    def side(df: DataFrame, tag: str) -> DataFrame:
        operators = (f"CASE WHEN group = 'Chunk 主计算' THEN {chunk.format(s='semantic_types')} WHEN group = {sql_text(GDN_METADATA_GROUP)} "
                     f"THEN coalesce(metadata_operator, {listed.format(s='semantic_types')}) ELSE {listed.format(s='semantic_types')} END")
        return df.selectExpr("pair_id", "group", f"total_duration_us AS {tag}_us", f"nullif({operators}, '') AS {tag}_ops",
                             f"scope = stage AS {tag}_aligned")

    both = side(left, "left").join(side(right, "right"), ["pair_id", "group"], "full").join(blocked, "pair_id")
    core = ", ".join(sql_text(c) for c in GDN_CORE_STAGES)
    operators = (f"IF(left_ops <> right_ops, concat({sql_text(names[0] + ': ')}, left_ops, '\\n', {sql_text(names[1] + ': ')}, right_ops), "
                 "coalesce(left_ops, right_ops))")
    return both.selectExpr("*", f"{operators} AS ops").selectExpr(
        "pair_id", "group", "concat(IF(group = 'Chunk 主计算', '分块主计算', group), coalesce(concat('（', ops, '）'), '')) AS label",
        "left_us", "right_us", *_ratios(
            f"size(blockers) = 0 AND coalesce(left_aligned AND right_aligned, FALSE) AND group IN ({core}) "
            f"AND group <> {sql_text(GDN_UNALIGNED_GROUP)}"))


def context_rate(left: DataFrame, right: DataFrame, left_time: DataFrame, right_time: DataFrame) -> DataFrame:
    """Context tokens per second of both sides of a pair, from the tokens of ``pair_id, prefill_tokens`` and the window's length in the
    time account; NULL without tokens or length. Pairs that count no tokens on either side have no row."""
    def side(work: DataFrame, time: DataFrame, tag: str) -> DataFrame:
        length = time.filter(F.col("row_ord") == len(TIME_ROWS) - 1).selectExpr("pair_id", "total_us")
        return work.select("pair_id", "prefill_tokens").join(length, "pair_id", "left").selectExpr(
            "pair_id", f"prefill_tokens AS {tag}_tokens",
            f"IF(prefill_tokens IS NOT NULL AND total_us > 0, prefill_tokens * 1000000D / total_us, NULL) AS {tag}_tokens_per_s")

    return side(left, left_time, "left").join(side(right, right_time, "right"), "pair_id", "full").filter("left_tokens IS NOT NULL OR right_tokens IS NOT NULL")


def report_checks(report: dict[str, DataFrame]) -> DataFrame:
    """Identities a report has to keep before it may be compared: ``trace_id, window_id, check_name, lhs, rhs, ok``.

    Classified and excluded time is what the kernels, and the events behind the coverage, sum to; coverage lies within the window;
    delta-network rows sum to their category; a category has one row.
    """
    keys = ["trace_id", "window_id"]
    classes = report["summary"].groupBy(*keys).agg(
        F.sum("total_duration_us").alias("classes"), F.count(F.lit(1)).cast("double").alias("n"), F.countDistinct("category").cast("double").alias("names"),
        F.min("total_duration_us").alias("least"), F.coalesce(F.sum(F.expr("IF(category = 'GDN', total_duration_us, 0D)")), F.lit(0.0)).alias("gdn"))
    excluded = report["excluded"].groupBy(*keys).agg(F.sum("total_duration_us").alias("excluded"))
    raw = report["kernels"].groupBy(*keys).agg(F.sum("total_duration_us").alias("raw"))
    stages = report["gdn_stages"].groupBy(*keys).agg(F.sum("total_duration_us").alias("gdn_rows"))
    coverage = report["coverage"].select(*keys, "selected_duration_sum_us", "device_covered_us", "window_total_us")
    one = (classes.join(excluded, keys, "left").join(raw, keys, "left").join(coverage, keys, "left").join(stages, keys, "left")
           .withColumn("whole", F.col("classes") + F.coalesce("excluded", F.lit(0.0))))
    near = "coalesce(abs({a} - {b}) <= greatest(1e-6D, abs({b}) * 1e-10D), FALSE)"
    checks = [("classes_equal_kernels", "whole", "raw", near.format(a="whole", b="raw")),
              ("classes_equal_selected", "whole", "selected_duration_sum_us", near.format(a="whole", b="selected_duration_sum_us")),
              ("coverage_within_window", "device_covered_us", "window_total_us",
               "coalesce(device_covered_us >= 0 AND window_total_us > 0 AND device_covered_us <= window_total_us, FALSE)"),
              ("gdn_rows_equal_category", "gdn_rows", "gdn", f"gdn_rows IS NULL OR {near.format(a='gdn_rows', b='gdn')}"),
              ("one_row_per_category", "n", "names", "n = names AND least >= 0")]
    rows = ", ".join(f"named_struct('check_name', '{name}', 'lhs', CAST({a} AS DOUBLE), 'rhs', CAST({b} AS DOUBLE), 'ok', {ok})" for name, a, b, ok in checks)
    return one.selectExpr(*keys, f"inline(array({rows}))")


def rank_blocks(summary: DataFrame, file_names: DataFrame) -> DataFrame:
    """Category rows with the rank of their trace file; ranks are kept apart, a repeated rank is flagged."""
    from ..functions.expressions import rank_of
    ranked = file_names.withColumn("rank", rank_of(F.col("file_name")))
    repeats = ranked.groupBy("rank").agg(F.expr("count(DISTINCT trace_id) > 1 AS repeated"))
    return summary.join(ranked.join(repeats, ranked["rank"].eqNullSafe(repeats["rank"])).drop(repeats["rank"]), "trace_id").selectExpr(
        *[f"`{c}`" for c in summary.columns], "rank", "IF(repeated AND rank IS NOT NULL, 'duplicate_rank', NULL) AS error_code")
