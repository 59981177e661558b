import random

import build
from pyspark.sql import functions as F

from stepscope.functions import sweep
from stepscope.operators import attribution, context, events, links
from stepscope.plans import catalog
from stepscope.sources.rules import load_rules

SPAN = "trace_id STRING, id BIGINT, start BIGINT, end BIGINT, kind STRING, d BIGINT"


def spans(rng, n, most):
    starts = [(rng.randrange(400), rng.choice([0, 1, 3, 40, 300])) for _ in range(n)]
    return [("t", i, s, s + d, rng.choice([None, "a", "b"]), d) for i, (s, d) in enumerate(starts)][:most]


def test_least_equals_brute_force(spark, small_bins):
    rng = random.Random(11)
    rows = spans(rng, 300, 300)
    points = [("t", i, t, t + rng.choice([-1, 0, 2, 60])) for i, t in enumerate([0, 399, 700, 5, 5] + [rng.randrange(450) for _ in range(150)])]
    p = spark.createDataFrame(points, "trace_id STRING, pid BIGINT, at BIGINT, until BIGINT")
    s = spark.createDataFrame(rows, SPAN)
    for k, lanes, until in ((1, [], None), (3, ["kind"], None), (2, ["kind"], "until"), (1, [], "until")):
        got = sweep.enclosing_least(p, s, ["trace_id"], "pid", "at", "start", "end", ["d", "id"], ["start"], lanes, k, until).collect()
        found = {(r.pid, lane.kind if lanes else None): (lane.n, [(x.d, x.id, x.start) for x in lane.least]) for r in got for lane in r.lanes}
        want = {}
        for _, i, at, to in points:
            for lane in (None, "a", "b") if lanes else (None,):
                around = sorted((d, j, a) for _, j, a, e, kind, d in rows if a <= at < e and (not lanes or kind == lane))
                reaching = [x for x in around if until is None or x[2] + x[0] >= to][:k]
                if reaching:
                    want[i, lane] = (len(around), reaching)
        assert found == want


def test_cuts_part_a_burst(spark, small_bins):
    """Points of a hundredth of the axis are cut as finely as the others."""
    frame = spark.createDataFrame([("t", i, 500_000 + i if i % 10 else i * 1000) for i in range(1000)], "trace_id STRING, id BIGINT, at BIGINT")
    cuts = sweep._cuts(frame, ["trace_id"], "at").collect()[0]._cuts
    assert cuts == sorted(set(cuts)) and len(cuts) >= sweep.MOST_CUTS // 2
    rows = sorted(r.at for r in frame.collect())
    held = [sum(a <= x < b for x in rows) for a, b in zip([0, *cuts], [*cuts, 1 << 62])]
    assert max(held) <= 4 * len(rows) / sweep.MOST_CUTS


def nested(n):
    """One thread whose frames and operators lie around all its calls."""
    rng = random.Random(12)
    rows = [build.row(i, rng.choice(["aten::mm", "_C_sdaa::group_gemm_v2", "vllm::qwen_gdn_attention_core"]), "cpu_op", i, 100_000 - 2 * i, external_id="e")
            for i in range(n)]
    rows += [build.row(10_000 + i, "layer.py(7): forward", "python_function", i, 100_000 - 2 * i) for i in range(n)]
    rows += [build.row(20_000 + i, "launch", "cuda_runtime", 10_000 + i, 5, correlation="c", external_id="e") for i in range(n)]
    return rows + [build.row(30_000 + i, "void k<32>(P)", "kernel", 50_000 + i, 5, device="0", correlation="c", external_id="e" if i % 2 else None) for i in range(n)]


def widest(spark, query):
    """Rows of the result, and the most rows any operator of its plan produced."""
    result = query.collect()

    def rows(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return rows(node.plan())
        metric = node.metrics().get("numOutputRows")
        children = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *[rows(children.apply(i)) for i in range(children.size())]])

    return result, rows(query._jdf.queryExecution().executedPlan())


def test_frames_and_operators_without_pairs(spark):
    """200 calls in 200 frames and operators each: no step lists the 40,000 pairs."""
    s = build.slices(spark, *nested(200))
    calls = s.filter("category = 'cuda_runtime'")
    frames, most = widest(spark, attribution.host_frames(calls, s.filter("category = 'python_function'")))
    assert len(frames) == 200 and {r.frame_count for r in frames} == {200} and {len(r.python_stack) for r in frames} == {8} and most < 4000
    ops, most = widest(spark, attribution.innermost_ops(calls, s.filter("category = 'cpu_op'")))
    assert {(r.op_id, r.op_dur) for r in ops} == {(199, 100_000 - 2 * 199)} and len(ops) == 200 and most < 4000


def test_scopes_without_pairs(spark):
    s = build.slices(spark, *nested(200))
    found, most = widest(spark, context.expert_launches(s, events.runtimes(s), load_rules()))
    last = max(r.id for r in s.filter("name = '_C_sdaa::group_gemm_v2'").collect())
    assert {(r.scope_id, r.host_op) for r in found} == {(last, "_C_sdaa::group_gemm_v2")} and len(found) == 200 and most < 4000
    scopes = context.gdn_scopes(s).withColumn("_last", F.expr("-(ts_ns + dur_ns)"))
    found, most = widest(spark, links.least_scopes(scopes, events.runtimes(s), ["_last"], lanes=("bits",)))
    assert len(found) == 200 and most < 4000


def test_sites_are_no_operators(spark):
    """A kernel has a row per site and way, not per operator around its launch."""
    s = build.slices(spark, *nested(40))
    got = attribution.attribution(s, attribution.classified_kernels(events.device_events(s), load_rules())).collect()
    keys = [(r.kernel_id, r.cpu_op, r.python_location, r.basis) for r in got]
    assert len(keys) == len(set(keys)) and {r.basis for r in got} == {"external-id", "correlation+launch-external-id"}
    assert {r.cpu_op for r in got} == {"aten::mm", "_C_sdaa::group_gemm_v2", "vllm::qwen_gdn_attention_core"}
    assert {len(r.python_stack) for r in got} == {8}


def test_parts_are_computed_once(spark, monkeypatch):
    """Stage and category tables of a comparison come from one computation of the contributions."""
    calls, whole = [], context.context_parts
    monkeypatch.setattr(context, "context_parts", lambda *a: calls.append(1) or whole(*a))
    catalog.QUERIES["report_compare"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
