from pyspark.sql import functions as F

import build
from stepscope.functions.expressions import ns_to_us_text, normalized_symbol, us_to_ns
from stepscope.operators import account, events, windows
from stepscope.sources.rules import load_rules


def one(df):
    return df.collect()[0].asDict()


def test_microsecond_text(spark):
    texts = ["34860750.232", "0.001", "NaN", "Infinity", "-1", "0.0001", "abc", "1792745261566929.123"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(us_to_ns(F.col("t")).alias("ns"))
    assert [r.ns for r in df.collect()] == [34860750232, 1, None, None, None, None, None, 1792745261566929123]
    back = spark.createDataFrame([(34860750232,), (1000,), (0,)], "ns BIGINT").select(ns_to_us_text(F.col("ns")).alias("t"))
    assert [r.t for r in back.collect()] == ["34860750.232", "1", "0"]


def test_symbols(spark):
    names = ["void teco_gemm<32>(Params)", "teco_gemm<64>", "f(g)(h(i))", "k 0xAb12 (x)", "open(", "a)b)"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING").select(normalized_symbol(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["teco_gemm<32>", "teco_gemm<64>", "f(g)", "k0xADDR", "open(", "a)b)"]


def device(spark, *spans, name="k"):
    return build.slices(spark, *[build.row(i, name, "kernel", ts, dur) for i, (ts, dur) in enumerate(spans)])


def test_coverage_overlap(spark, small_bins):
    c = one(account.window_coverage(device(spark, (0, 40), (30, 20), (70, 10), (85, 0)), build.window(spark, 0, 100)))
    assert (c["selected_duration_sum_us"], c["device_covered_us"], c["bubble_us"], c["overlap_or_outside_deduction_us"]) == (.07, .06, .04, .01)


def test_coverage_clip_and_carry_in(spark, small_bins):
    c = one(account.window_coverage(device(spark, (70, 50), (-10 + 1000, 5), (90 - 100 + 1000, 1)), build.window(spark, 0, 100)))
    assert c["selected_covered_us"] == .03
    shifted = device(spark, (1070, 50), (990, 30))
    c = one(account.window_coverage(shifted, build.window(spark, 1000, 1100)))
    assert (c["selected_covered_us"], c["carry_in_extra_coverage_us"], c["device_covered_us"], c["bubble_us"], c["net_boundary_adjustment_us"]) \
        == (.03, .02, .05, .05, 0)
    assert c["carry_in_event_count"] == 1


def test_window_selection_and_markers(spark):
    rows = build.slices(
        spark, build.row(1, "slave_gemm_x", "kernel", 10000, 2000), build.row(2, "cross_end", "kernel", 19000, 5000),
        build.row(3, "before", "kernel", 5000, 6000), build.row(4, "after", "kernel", 20000, 1000),
        build.row(5, "cpu", "cpu_op", 12000, 1000))
    w = build.window(spark, 10000, 20000)
    agg = {r.name: r for r in account.kernel_aggregate(events.window_events(rows), w).collect()}
    assert set(agg) == {"slave_gemm_x", "cross_end"}
    assert sum(r.total_duration_us for r in agg.values()) == 7
    assert sum(r.window_absolute_pct for r in agg.values()) == 70
    meta = one(windows.window_metadata(events.window_events(rows), w))
    assert meta["events_crossing_end"] == 1 and meta["selected_event_count"] == 2


def test_wait_and_set_stay_in_raw_share_only(spark):
    rows = build.slices(spark, build.row(1, "slave_gemm_x", "kernel", 0, 1000), build.row(2, "WAIT", "kernel", 10, 2000),
                        build.row(3, "SET", "kernel", 20, 1000))
    w = build.window(spark, 0, 10000)
    raw = {r.name: r for r in account.kernel_aggregate(rows, w).collect()}
    assert raw["slave_gemm_x"].kernel_relative_pct == 25 and len(raw) == 3
    totals = account.kernel_totals(windows.started_in(rows, w))
    summary = {r.category: r for r in account.category_summary(totals, load_rules()).collect()}
    assert summary["gemm"].kernel_relative_pct == 100 and len(summary) == 6
    assert sum(r.total_duration_us for r in account.excluded_markers(totals, load_rules()).collect()) == 3


def test_average_is_whole_nanoseconds(spark):
    rows = build.slices(spark, build.row(1, "a", "kernel", 0, 1001), build.row(2, "a", "kernel", 10, 1002))
    r = one(account.kernel_aggregate(rows, build.window(spark, 0, 10000)))
    assert (r["total_duration_us"], r["avg_duration_us"]) == (2.003, 1.001)


def test_time_account(spark):
    rows = build.slices(spark, build.row(1, "slave_gemm_x", "kernel", 0, 40000), build.row(2, "WAIT", "kernel", 30000, 20000))
    got = [r.total_us for r in account.time_account(rows, build.window(spark, 0, 100000), load_rules()).orderBy("row_ord").collect()]
    assert got == [40, 20, 60, -10, 50, 50, 100]


def test_relative_windows(spark):
    bounds = spark.createDataFrame([("t", 1000, 5000)], "trace_id STRING, trace_start_ns BIGINT, trace_end_ns BIGINT")
    asked = spark.createDataFrame([("t", "0.5", "1"), ("t", "1", "1"), ("t", "0", "5"), ("t", "x", "1"), ("u", "0", "1")],
                                  "trace_id STRING, start_us STRING, end_us STRING")
    got = sorted((r.start_us, r.error_code or "") for r in windows.relative_windows(asked, bounds).collect())
    assert got == [("0", "beyond_trace_bounds"), ("0", "unknown_trace"), ("0.5", ""), ("1", "empty_window"), ("x", "invalid_time")]
