import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from stepscope.operators import account, annotations, events, gemm, keyword, occupancy, phases, windows
from stepscope.plans.reports import phase_report
from stepscope.sources import sinks, tables, traces
from stepscope.sources.rules import RuleError, load_rules, parse_rules, violations
from stepscope.streaming import rollup

EVENTS = [
    {"ph": "X", "cat": "cuda_runtime", "name": "cudaLaunchKernel", "pid": 1, "tid": 2, "ts": 10.5, "dur": 5, "args": {"correlation": 7, "External id": 3}},
    {"ph": "s", "cat": "ac2g", "name": "ac2g", "id": 9, "pid": 1, "tid": 2, "ts": 11},
    {"ph": "f", "bp": "e", "cat": "ac2g", "name": "ac2g", "id": 9, "pid": 0, "tid": 5, "ts": 20},
    {"ph": "X", "cat": "kernel", "name": "slave_gemm_x", "pid": 0, "tid": 5, "ts": 20, "dur": 2.25, "args": {"Correlation-ID": 7, "device": 0, "stream": 4}},
    {"ph": "M", "name": "process_name", "pid": 1, "args": {"name": "x"}},
]


@pytest.fixture
def trace_dir(tmp_path):
    (tmp_path / "a_rank0.json").write_text(json.dumps({"schemaVersion": 1, "deviceProperties": [], "traceEvents": EVENTS}))
    with gzip.open(tmp_path / "b_rank1.json.gz", "wt") as f:
        f.write(json.dumps(EVENTS))
    (tmp_path / "c.json").write_text(json.dumps({"events": EVENTS[:1]}))
    (tmp_path / "d.json").write_text(json.dumps(EVENTS[3]))
    return tmp_path


def test_document_shapes(spark, trace_dir):
    ev = traces.read_traces(spark, str(trace_dir))
    counts = {r.trace_id.rsplit("/", 1)[1]: r["count"] for r in ev.groupBy("trace_id").count().collect()}
    assert counts == {"a_rank0.json": 5, "b_rank1.json.gz": 5, "c.json": 1, "d.json": 1}
    s = traces.slices(ev)
    k = s.filter("name = 'slave_gemm_x' AND trace_id LIKE '%b_rank1%'").collect()[0]
    assert (k.ts_ns, k.dur_ns, k.correlation, k.device, k.stream) == (20000, 2250, "7", "0", "4")
    f = traces.flows(ev, s).filter("trace_id LIKE '%a_rank0%'").collect()
    by_id = {r.id: r.name for r in s.filter("trace_id LIKE '%a_rank0%'").collect()}
    assert [(by_id[r.slice_out], by_id[r.slice_in]) for r in f] == [("cudaLaunchKernel", "slave_gemm_x")]
    assert {r.rank for r in traces.trace_files(ev).collect()} == {0, 1, None}
    assert traces.single_trace_groups(traces.trace_files(ev)).collect()[0].error_code == "several_traces"


def test_streaming_splitter_and_store(spark, trace_dir, tmp_path):
    whole = traces.read_traces(spark, str(trace_dir / "a_rank0.json")).drop("trace_id")
    split = traces.read_large_traces(spark, [str(trace_dir / "a_rank0.json")]).drop("trace_id")
    key = lambda r: (r.ord, r.ph, r.name, r.ts_us, r.dur_us, r.pid, sorted((r.args or {}).items()))
    assert sorted(map(key, split.collect())) == sorted(map(key, whole.collect()))
    traces.store(traces.read_traces(spark, str(trace_dir)), str(tmp_path / "bronze"))
    with pytest.raises(Exception):
        traces.store(whole, str(tmp_path / "bronze"))


TRICKY = [{"ph": "X", "name": 'a"},{"x":[\\', "ts": 1.0005, "dur": 2, "pid": 1, "tid": 2, "args": {"correlation": 7, "deep": {"a": [{"b": "]}"}]}}},
          {"ph": "X", "name": "\\\\\"{", "ts": 3, "args": {}}, {"name": "é \\", "ph": "M"}, {"ph": "X", "name": "x" * 300, "ts": 4, "dur": 0}]


def test_readers_agree_on_roots_and_defects(spark, tmp_path):
    """Also on documents that are cut anywhere; ranges of a few bytes begin inside strings, escapes and nested objects."""
    whole_text = json.dumps({"schemaVersion": 1, "meta": {"events": [{"name": "no"}]}, "traceEvents": TRICKY, "other": [{"name": "no"}], "z": "traceEvents"}, indent=1)
    texts = {"list": json.dumps(TRICKY), "events": json.dumps({"a": "\\\"", "events": TRICKY, "b": [1, {"c": 2}]}), "single": json.dumps(TRICKY[0]),
             "late": json.dumps({"events": TRICKY[:1], "n": -1.5, "traceEvents": TRICKY}), "object": whole_text, "broken": "not json", "open": "[",
             "none": '{"traceEvents": []}', "mixed": "[1, \"{\", " + json.dumps(TRICKY[0]) + ", null, [{\"name\": \"no\"}]]",
             **{f"cut{n}": whole_text[:n] for n in range(150, len(whole_text) - 1, 97)}}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        with gzip.open(tmp_path / f"{name}_z.json.gz", "wt") as file:
            file.write(text)
    def rows(df):
        out = {}
        for r in df.orderBy("trace_id", "ord").collect():
            out.setdefault(r.trace_id.split("/")[-1], []).append((r.name, r.ph, r.ts_us, r.dur_us, sorted((k, re.sub(r"\s", "", v)) for k, v in (r.args or {}).items())))
        return out
    errors = lambda df: {r.trace_id.split("/")[-1]: r.error_code for r in traces.trace_errors(df).collect()}
    whole = traces.read_traces(spark, str(tmp_path))
    expected, codes = rows(whole), errors(whole)
    assert {k for k in codes if "_z" not in k} == {"broken.json", "open.json", *(f"{n}.json" for n in texts if n.startswith("cut") and int(n[3:]) <= whole_text.index('],\n "other"'))}
    names = [e["name"] for e in TRICKY]
    for name in ("list", "events", "late", "object", "list_z", "events_z", "late_z", "object_z"):
        assert [r[0] for r in expected[f"{name}.json{'.gz' if '_z' in name else ''}"]] == names
    for size in (7, 64, 1 << 20):
        split = traces.read_large_traces(spark, str(tmp_path), size)
        got = rows(split)
        for name in set(expected) | set(got):
            assert got.get(name) == expected.get(name) or name.startswith("mixed"), (size, name)
        assert errors(split) == codes
        assert [r[0] for r in got["mixed.json"]] == [TRICKY[0]["name"]] == [r[0] for r in got["mixed_z.json.gz"]]
    counted = {r.trace_id.split("/")[-1]: r.event_count for r in traces.event_counts(whole).collect()}
    assert counted["object.json"] == 4 and counted["broken.json"] == 0


def test_rules_contract(tmp_path, spark):
    good = json.loads((__import__("importlib").resources.files("stepscope") / "rules" / "kernel_rules.json").read_text())
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(good))
    assert load_rules(spark, str(path), "nv").platform == "nv"
    for change in (lambda a: a.update(schema_version=4), lambda a: a["platforms"].pop("nv"), lambda a: a["platforms"]["nv"][0].update(priority="1"),
                   lambda a: a["platforms"]["dcu"][0].update(patterns=["("]), lambda a: a["platforms"]["nv"][0].update(id="fallback"),
                   lambda a: a["platforms"]["nv"][0].update(category="x"), lambda a: a["fallback"].update(category=None)):
        broken = json.loads(json.dumps(good))
        change(broken)
        with pytest.raises(RuleError):
            parse_rules(json.dumps(broken), "teco")
    with pytest.raises(RuleError):
        parse_rules('{"a": 1, "a": 2}')
    broken = json.loads(json.dumps(good))
    broken["platforms"]["nv"][0].update(patterns=["(", "x*+"], confidence="sure", notes=" ")
    broken["platforms"]["dcu"].append({**good["platforms"]["nv"][0], "match_on": "cpu_op", "priority": True})
    broken["platforms"]["teco"].append("no rule")
    assert [place for place, _ in violations(json.dumps(broken))] == [
        "platforms.nv[0].confidence", "platforms.nv[0].notes", f"platforms.dcu[{len(good['platforms']['dcu'])}].priority",
        f"platforms.teco[{len(good['platforms']['teco'])}]", f"platforms.dcu[{len(good['platforms']['dcu'])}].id",
        f"platforms.dcu[{len(good['platforms']['dcu'])}]", "platforms.nv[0].patterns"]
    assert violations("{") and violations("[]") and violations(json.dumps(good)) == []


def test_tables_and_configs(spark, tmp_path):
    (tmp_path / "k.csv").write_text(f"name,record_count,total_duration_us,old\n\nslave_gemm_x,2,6,q\n,,,\n\n\"W,AIT\",1,3,\n{tables.PARTS_BANNER},,,\nx,1,1,\n", encoding="utf8")
    rows = tables.raw_kernel_rows(tables.read_delimited(spark, str(tmp_path / "k.csv"))).orderBy("source_row").collect()
    assert [(r.source_row, r.name, r.record_count, r.error_code) for r in rows] == [(3, "slave_gemm_x", 2, None), (6, "W,AIT", 1, None)]
    (tmp_path / "a.tsv").write_text("kernel_name\tduration_us\nslave_gemm_x\t12\n", encoding="utf8")
    got = tables.kernel_names(tables.read_delimited(spark, str(tmp_path / "a.tsv"))).collect()[0]
    assert (got.name, got.record_count, got.duration_us) == ("slave_gemm_x", 1, 12.0)
    (tmp_path / "c.json").write_text(json.dumps({"mapping": {"graph_enabled": False, "bs": 1}, "formal": {"graph_enabled": True}}))
    kv = {(r.side, r.field): r.value for r in tables.read_run_configs(spark, str(tmp_path / "c.json")).collect()}
    assert kv[("mapping", "bs")] == "1" and kv[("formal", "graph_enabled")] == "true"


def test_benchmark_logs(spark, tmp_path):
    (tmp_path / "cases.txt").write_text("\n# note\n16320 ./rocblas-bench -f gemm_ex --transposeA N --transposeB N -m 8192 -n 1 -k 7392 --a_type bf16_r\n")
    case = gemm.rocblas_cases(tables.case_lines(tables.read_lines(spark, str(tmp_path / "cases.txt")))).collect()[0]
    assert (case.line, case.m, case.n, case.k, case.transA, case.lda) == (1, "8192", "1", "7392", "N", None)
    (tmp_path / "logs" / "baseline").mkdir(parents=True)
    (tmp_path / "logs" / "baseline" / "line_1_m8192.log").write_text(
        "[0]:transA,us\n    T,N,0,1,128,f16_r,4.48877,7.3\n    --kernel name:    Cijk_Alik_Bljk_F8BS_MT16x16x64\n")
    r = gemm.log_results(tables.log_lines(tables.read_lines(spark, str(tmp_path / "logs" / "baseline")))).collect()[0]
    assert (r.line, r.variant, r.kernel, r.gflops, r.us) == (1, "baseline", "Cijk_Alik_Bljk_F8BS_MT16x16x64", 4.48877, 7.3)
    lt = spark.createDataFrame([(1, "hipblaslt-bench -m 10 -n 1 -k 8 --transA T --transB N --bias_vector --a_type f8_r")], "line BIGINT, text STRING")
    c = gemm.hipblaslt_cases(lt).collect()[0]
    assert (c.batch_count, c.activation_type, c.bias_vector, c.scaleA) == ("1", "none", "1", "0")


def test_boxed_monitor_table(spark):
    text = ["| 0  T100  On  0000:01 | x 55% |", "| N/A  x y  512MB / 16384MB |", "| 1  T100  On  0000:02 | x 0% |", "| N/A  x y  0MB / 16384MB |",
            "| Processes: |", "|  0  4321  C  python serve.py  512  MB |"]
    lines = spark.createDataFrame([("n", i, t) for i, t in enumerate(text)], "node STRING, line_no BIGINT, text STRING")
    cards, procs = occupancy.table_records(lines)
    got = {r.card: r for r in cards.collect()}
    assert set(got) == {0, 1} and got[0].mem_used == "512MB" and got[0].util == "55%"
    owned = occupancy.owners(procs, spark.createDataFrame([("n", 4321, "MAP", "box")], "node STRING, pid BIGINT, tag STRING, container STRING"))
    assert {r.card: r.state for r in occupancy.card_state(cards, owned).collect()} == {0: "busy", 1: "idle"}


def test_phase_annotation(spark):
    name = "PHASE_GRAPH step=27 phase=prefill tokens=2 padded=2 mode=PIECEWISE computed=[33841] prompt=[83008]"
    r = annotations.phase_fields(spark.createDataFrame([(name,)], "name STRING")).collect()[0]
    assert (r.step, r.phase, r.tokens, r.padded, r.mode, r.computed, r.prompt) == (27, "prefill", 2, 2, "PIECEWISE", [33841], [83008])


def test_phases_count_fast_steps_from_zero(spark):
    ms = 1_000_000
    starts = [0, 200, 220, 240, 260, 280]
    rows = spark.createDataFrame([("t", i, "model_forward", s * ms, 10 * ms) for i, s in enumerate(starts)],
                                 "trace_id STRING, id BIGINT, name STRING, ts_ns BIGINT, dur_ns BIGINT")
    got = {r.stage: (r.start_ns // ms, r.end_ns // ms) for r in phases.phase_windows(rows, windows.trace_bounds(rows)).collect()}
    assert got == {"prefill": (0, 200), "decode": (240, 260)}
    flat = rows.filter("id > 0")
    got = {r.stage: (r.start_ns // ms, r.end_ns // ms) for r in phases.phase_windows(flat, windows.trace_bounds(flat)).collect()}
    assert got == {"prefill": (200, 210), "decode": (240, 250)}
    alone = rows.filter("id = 0")
    assert phases.phase_windows(alone, windows.trace_bounds(alone)).collect()[0].error_code == "single_forward"


def test_report_sinks(spark, trace_dir, tmp_path):
    s = traces.slices(traces.read_traces(spark, str(trace_dir / "a_rank0.json")))
    stats = keyword.operator_stats(s)
    sinks.write_report({"operators": stats}, str(tmp_path / "out"), [], "csv")
    assert spark.read.csv(str(tmp_path / "out" / "operators"), header=True).collect()[0].category == "gemm"
    with pytest.raises(Exception):
        sinks.write_report({"operators": stats}, str(tmp_path / "out"), fmt="csv")
    with pytest.raises(ValueError):
        sinks.write_report({"operators": stats}, str(tmp_path / "src"), [str(tmp_path / "src")])
    assert set(phase_report(s, load_rules())) == {"phases", "steps", "detail", "categories", "summary"}


def test_device_categories_are_checked():
    for bad in (["cpu_op"], ["cuda_runtime"], ["x_driver"]):
        with pytest.raises(ValueError):
            events.check_device_categories(bad)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "'t' AS trace_id", "id", "IF(id % 3 = 0, 'WAIT', 'slave_gemm_x') AS name", "'kernel' AS category", "id * 1000000000 AS ts_ns",
        "id + 1 AS dur_ns", "0L AS track_id", "CAST(NULL AS STRING) AS device")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (rollup.kernel_stream(stream).writeStream.outputMode("complete").format("memory").queryName("rollup")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    got = rollup.categories(spark.table("rollup"), load_rules()).collect()
    want = rollup.categories(rollup.kernel_stream(rows), load_rules()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.record_count for r in got) == 133
