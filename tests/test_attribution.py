import build
from stepscope.operators import attribution, events
from stepscope.sources.rules import load_rules


def mapped(spark, *rows):
    s = build.slices(spark, *rows)
    return attribution.attribution(s, attribution.classified_kernels(events.device_events(s), load_rules()))


def kernel(id=1, ts=200, **more):
    return build.row(id, "void k<32>(P)", "kernel", ts, 10, device="0", **more)


def status(spark, found, name="k<32>"):
    rows = spark.createDataFrame([("t", name, 1, 5.0)], "trace_id STRING, kernel_name STRING, call_count BIGINT, total_duration_us DOUBLE")
    return attribution.attach_sources(rows, attribution.symbol_sites(found), attribution.symbol_links(found)).collect()[0]


FRAME = build.row(90, "layer.py(7): forward", "python_function", 0, 1000)
OP = dict(tid="1")


def test_external_id(spark):
    found = attribution.materialize(mapped(spark, FRAME, build.row(2, "aten::mm", "cpu_op", 50, 100, external_id="e"),
                                           build.row(3, "launch", "cuda_runtime", 60, 5, correlation="c"), kernel(correlation="c", external_id="e")))
    r = found.collect()[0]
    assert (r.cpu_op, r.python_location, r.basis) == ("aten::mm", "layer.py(7): forward", "external-id")
    s = status(spark, found)
    assert (s.source_status, s.match_basis) == ("mapped", "name:normalized")


def test_launch_external_id_then_enclosure_then_frame(spark):
    op = build.row(2, "aten::mm", "cpu_op", 50, 100, external_id="e")
    launch = build.row(3, "launch", "cuda_runtime", 60, 5, correlation="c", external_id="e")
    plain = build.row(3, "launch", "cuda_runtime", 60, 5, correlation="c")
    assert mapped(spark, FRAME, op, launch, kernel(correlation="c")).collect()[0].basis == "correlation+launch-external-id"
    assert mapped(spark, FRAME, op, plain, kernel(correlation="c")).collect()[0].basis == "correlation+host-thread-enclosure"
    found = attribution.materialize(mapped(spark, FRAME, plain, kernel(correlation="c")))
    assert found.collect()[0].basis == "correlation+python-frame" and status(spark, found).source_status == "partial"


def test_graph_launches(spark):
    graph = build.row(3, "cudaGraphLaunch", "cuda_runtime", 60, 5, correlation="c")
    found = attribution.materialize(mapped(spark, FRAME, graph, kernel(correlation="c")))
    assert found.collect()[0].reason == "graph-launch-only" and status(spark, found).source_status == "unresolved"
    op = build.row(4, "aten::mm", "cpu_op", 50, 100, tid="2")
    other = build.row(5, "launch", "cuda_runtime", 70, 5, correlation="c", tid="2")
    mixed = attribution.materialize(mapped(spark, FRAME, graph, op, other, kernel(correlation="c")))
    assert mixed.collect()[0].reason == "mixed-graph-and-kernel-launch-links" and status(spark, mixed).source_status == "ambiguous"


def test_two_layers_are_ambiguous_and_markers_drop(spark):
    second = [build.row(12, "aten::linear", "cpu_op", 1050, 100), build.row(13, "launch", "cuda_runtime", 1060, 5, correlation="d"),
              kernel(14, 1200, correlation="d"), build.row(15, "WAIT", "kernel", 1300, 5, correlation="d")]
    first = [build.row(2, "aten::mm", "cpu_op", 50, 100), build.row(3, "launch", "cuda_runtime", 60, 5, correlation="c"), kernel(correlation="c")]
    found = attribution.materialize(mapped(spark, FRAME, *first, *second))
    s = status(spark, found)
    assert s.source_status == "ambiguous" and s.source_count == 2 and "multiple-source-sites" in s.ambiguity_reasons
    assert status(spark, found, "k<64>").ambiguity_reasons == ["no-symbol-match"]


def test_reused_correlation_takes_the_latest_launch(spark):
    rows = [build.row(2, "old", "cpu_op", 0, 30), build.row(3, "launch", "cuda_runtime", 10, 5, correlation="c"),
            build.row(4, "new", "cpu_op", 50, 30), build.row(5, "launch", "cuda_runtime", 60, 5, correlation="c"),
            build.row(6, "late", "cpu_op", 300, 30), build.row(7, "launch", "cuda_runtime", 310, 5, correlation="c"), kernel(correlation="c")]
    assert [r.cpu_op for r in mapped(spark, *rows).collect()] == ["new"]


def test_config_diff(spark):
    schema = "trace_id STRING, field STRING, value STRING"
    off = spark.createDataFrame([("t", "graph_enabled", "false"), ("t", "bs", "1"), ("t", "only", "x")], schema)
    on = spark.createDataFrame([("t", "graph_enabled", "true"), ("t", "bs", "2")], schema)
    assert sorted(r.field for r in attribution.config_diff(off, on).collect()) == ["bs", "only"]
    assert attribution.config_flags(off, on).collect()[0].error_code is None
    assert attribution.config_flags(on, off).collect()[0].error_code == "graph_flags_not_declared"
