import build
from stepscope.operators import context, events
from stepscope.sources.rules import load_rules

GEMM = "void slave_gemm_x(Args)"


def pieces(spark, rows, edges=()):
    s = build.slices(spark, *rows)
    return s, events.window_events(s), events.runtimes(s), build.flows(spark, *edges)


def expert_rows(second_conflict=False):
    return [build.row(1, "_C_sdaa::group_gemm_v2", "cpu_op", 0, 100), build.row(10, "launch", "cuda_runtime", 10, 5, correlation="7"),
            build.row(11, "launch", "cuda_runtime", 300, 5, correlation="8"),
            build.row(101, GEMM, "kernel", 400, 5, correlation="7"), build.row(102, GEMM, "kernel", 500, 5, correlation="8")]


def test_expert_and_residual_calls(spark):
    s, device, runtimes, flows = pieces(spark, expert_rows())
    rules = load_rules()
    profile = context.expert_profile(device, runtimes, flows, context.expert_launches(s, runtimes, rules))
    got = {r.part: r for r in context.moe_split(profile, build.window(spark, 0, 1000), rules).collect()}
    assert (got["expert"].record_count, got["expert"].duration_ns, got["expert"].category) == (1, 5, "group gemm")
    assert (got["residual"].record_count, got["residual"].duration_ns, got["residual"].confidence) == (1, 5, "unknown")
    assert {r.id for r in profile.filter("expert_basis IS NOT NULL").collect()} == {101}


def test_conflict_in_one_scope_resolves_the_category(spark):
    rows = [build.row(1, "_C_sdaa::group_gemm_v2", "cpu_op", 0, 100), build.row(10, "launch", "cuda_runtime", 10, 5, correlation="7"),
            build.row(11, "launch", "cuda_runtime", 30, 5, correlation="8"), build.row(101, GEMM, "kernel", 400, 5, correlation="7")]
    s, device, runtimes, flows = pieces(spark, rows, [(11, 101)])
    rules = load_rules()
    profile = context.expert_profile(device, runtimes, flows, context.expert_launches(s, runtimes, rules))
    part = context.moe_split(profile, build.window(spark, 0, 1000), rules).collect()[0]
    assert (part.category, part.confidence, part.launch_confidence) == ("group gemm", "high", "ambiguous")
    assert sorted(r.launch_id for r in context.launch_conflicts(profile, runtimes, flows).collect()) == [10, 11]
    apart = [build.row(1, "_C_sdaa::group_gemm_v2", "cpu_op", 0, 20), build.row(2, "_C_sdaa::group_gemm_v2", "cpu_op", 25, 20), *rows[1:]]
    s, device, runtimes, flows = pieces(spark, apart, [(11, 101)])
    profile = context.expert_profile(device, runtimes, flows, context.expert_launches(s, runtimes, rules))
    part = context.moe_split(profile, build.window(spark, 0, 1000), rules).collect()[0]
    assert (part.part, part.category, part.ambiguous_count) == ("residual", "gemm", 1)


def test_shared_convolution_kernel_splits_by_scope(spark):
    name = "teco_slave_causal_conv1d_perf(Args)"
    rows = [build.row(1, "vllm::qwen_gdn_attention_core", "cpu_op", 0, 100), build.row(2, "_C_sdaa::custom_causal_conv1d_update", "cpu_op", 5, 20),
            build.row(3, "_C_sdaa::custom_causal_conv1d_fn", "cpu_op", 40, 20),
            build.row(10, "launch", "cuda_runtime", 10, 5, correlation="1"), build.row(11, "launch", "cuda_runtime", 45, 5, correlation="2"),
            build.row(12, "launch", "cuda_runtime", 200, 5, correlation="3"),
            *[build.row(100 + i, name, "kernel", 300 + i, 7, correlation=str(i)) for i in (1, 2, 3)]]
    s, device, runtimes, flows = pieces(spark, rows)
    rules, w = load_rules(), build.window(spark, 0, 1000)
    parts = context.context_parts(s, device, runtimes, flows, w, rules)
    assert {(r.semantic_type, r.record_count) for r in parts.collect()} == {("gdn_conv_update", 1), ("gdn_conv", 1), ("conv_state", 1)}
    summary = {r.category: r for r in context.parts_summary(parts).collect()}
    assert (summary["GDN"].record_count, summary["GDN"].kernel_kinds, summary["其他elementwise"].record_count) == (2, 1, 1)
    assert {r.scope for r in context.gdn_stage_summary(parts, w).collect()} == {"mixed-or-stage-mismatch"}


def test_moe_denominator_and_open_gemm(spark):
    rows = [build.row(1, GEMM, "kernel", 0, 40), build.row(2, "fused_moe_kernel", "kernel", 50, 20), build.row(3, "WAIT", "kernel", 60, 20)]
    s, device, runtimes, flows = pieces(spark, rows)
    rules, w = load_rules(), build.window(spark, 0, 1000)
    parts = context.context_parts(s, device, runtimes, flows, w, rules)
    got = {r.category: r.kernel_relative_pct for r in context.parts_summary(parts).collect()}
    assert round(got["gemm"], 6) == round(40 / 60 * 100, 6) and round(got["group gemm"], 6) == round(20 / 60 * 100, 6)
    helper = [build.row(1, GEMM, "kernel", 0, 40), build.row(2, "moe_align_block_size_kernel", "kernel", 50, 20)]
    s, device, runtimes, flows = pieces(spark, helper)
    parts = context.context_parts(s, device, runtimes, flows, w, rules)
    assert [r.name for r in context.downgraded_gemm(parts).collect()] == [GEMM]
    assert "group gemm" in {r.category for r in context.parts_summary(parts).collect()}
