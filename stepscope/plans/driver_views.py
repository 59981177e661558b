"""Deterministic trace, benchmark and occupancy views over the driver's star-schema tables.

The driver data holds no traces, so each operator runs on a projection of whole driver tables that has
the shape and the difficult cases of the real input: reused ids, conflicting links, nested scopes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import DEVICE_NAMES
from ..functions.layout import latest_before
from ..operators.classify import sql_text
from ..sources.tables import PARTS_BANNER

HOUR_NS = 3_600_000_000_000
SLOT_NS = 6 * HOUR_NS
ORIGIN_NS = 1_704_067_200_000_000_000  # 2024-01-01
MAPPING_END_NS = 1_705_363_200_000_000_000  # 2024-01-16
STEP_ID_BASE = 1_000_000_000_000

RUNTIME_NAMES = ["sdaaLaunchKernel", "cudaLaunchKernel", "sdaaGraphLaunch", "hipMemcpyAsync"]
CPU_OP_NAMES = ["aten::mm", "_C_sdaa::group_gemm_v2", "vllm::qwen_gdn_attention_core",
                "_C_sdaa::custom_causal_conv1d_update", "aten::linear"]
FRAME_NAMES = ["model.py(100): forward", "torch/nn/modules/module.py(1): call", "layer.py(7): forward"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(column: str) -> str:
    """SQL for the nanoseconds of a zone-less timestamp, independent of the session zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) * 1000"


def _pick(names: list[str], index: str) -> str:
    return f"element_at(array({', '.join(sql_text(n) for n in names)}), CAST({index} + 1 AS INT))"


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trace_event`` rows from ``events``: complete events, counters and flow marks, with attributes in several spellings."""
    number = "regexp_extract(props, '([0-9]+)', 1)"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('run_rank', user_id % 5, '.json') AS trace_id", "event_id AS ord",
        "CASE WHEN event_id % 11 = 0 THEN 'C' WHEN event_id % 13 = 0 THEN 's' WHEN event_id % 17 = 0 THEN NULL ELSE 'X' END AS ph",
        "IF(event_type = 'signup', 'cuda_runtime', event_type) AS cat", "concat(event_type, '<', user_id, '>') AS name",
        "CAST(user_id % 3 AS STRING) AS pid", "IF(user_id % 7 = 0, NULL, CAST(user_id % 7 AS STRING)) AS tid",
        "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DECIMAL(22,3)) AS ts_us", "IF(event_id % 5 = 0, NULL, CAST(value AS DECIMAL(22,3))) AS dur_us",
        "IF(event_id % 13 = 0, CAST(user_id AS STRING), NULL) AS flow_id", "CAST(NULL AS STRING) AS bp",
        f"map(IF(event_id % 2 = 0, 'Correlation', 'correlation_id'), {number}, IF(event_id % 3 = 0, 'External id', 'external_id'), CAST(user_id AS STRING), "
        "IF(event_id % 2 = 0, 'Device ID', 'device'), CAST(user_id % 4 AS STRING), 'stream', event_type) AS args")


def trace_documents(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the trace events as JSON documents, one per trace, whose names hold brackets, quotes and backslashes.

    A document is one file, so one task writes it."""
    events = trace_events(spark, sf_dir).selectExpr(
        "trace_id", "ord", f"to_json(named_struct('ph', ph, 'cat', cat, 'name', {document_name()}, 'pid', pid, 'tid', tid, 'ts', ts_us, 'dur', dur_us, "
        "'id', flow_id, 'args', args)) AS event")
    ends = events.groupBy("trace_id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    lines = events.join(ends, "trace_id").selectExpr(
        "trace_id", "ord", """concat(IF(ord = first, '{"schemaVersion": 1, "meta": {"events": [1, "["]}, "traceEvents": [', ''), event,
                              IF(ord = last, '], "other": [{"name": "no event"}]}', ',')) AS value""")
    (lines.repartition("trace_id").sortWithinPartitions("trace_id", "ord").select("trace_id", "value")
     .write.partitionBy("trace_id").text(folder))


def document_name() -> str:
    """Name of an event in a document: what a splitter could take for structure."""
    return r"""concat(name, '\\"},{"', cat, '\\\\')"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slice`` table from ``events``."""
    device = "category IN ('kernel', 'gpu_memcpy', 'gpu_memset')"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id", f"{epoch_ns('ts')} AS ts_ns", "CAST(floor(value * 100D + 0.5D) AS BIGINT) AS c",
        "regexp_extract(props, '([0-9]+)', 1) AS correlation",
        "CASE event_type WHEN 'purchase' THEN 'kernel' WHEN 'click' THEN 'gpu_memcpy' WHEN 'error' THEN 'gpu_memset' "
        "WHEN 'signup' THEN 'cuda_runtime' ELSE IF(event_id % 2 = 0, 'cpu_op', 'python_function') END AS category",
    ).selectExpr(
        "concat('run_rank', user_id % 4) AS trace_id", "id",
        f"CASE WHEN {device} THEN {_pick(DEVICE_NAMES, f'(id * 7 + CAST(correlation AS BIGINT)) % {len(DEVICE_NAMES)}')} "
        f"WHEN category = 'cuda_runtime' THEN {_pick(RUNTIME_NAMES, 'id % 4')} "
        f"WHEN category = 'cpu_op' THEN {_pick(CPU_OP_NAMES, 'id % 5')} "
        f"ELSE {_pick(FRAME_NAMES, 'id % 3')} END AS name",
        "category", "ts_ns",
        f"CASE WHEN {device} THEN c * 600000000 WHEN category = 'cuda_runtime' THEN 1000000000 "
        "ELSE c * 2400000000 END AS dur_ns",
        "user_id AS track_id", "'1' AS pid", "CAST(user_id % 8 AS STRING) AS tid",
        "concat('1/', user_id % 8) AS host_thread", "correlation",
        f"CASE WHEN {device} AND id % 4 <> 0 THEN NULL WHEN category = 'cuda_runtime' AND id % 3 <> 0 THEN NULL "
        "WHEN category = 'python_function' THEN NULL ELSE concat('x', correlation) END AS external_id",
        f"CASE WHEN {device} THEN '0' END AS device", f"CASE WHEN {device} THEN CAST(user_id % 3 AS STRING) END AS stream",
        "CAST(NULL AS STRING) AS norm_mode", "CAST(NULL AS STRING) AS gate_type")


def flows(slice_df: DataFrame) -> DataFrame:
    """``flow`` edges: the nearest earlier launch, by correlation or (to create conflicts) without it."""
    launches = slice_df.filter("category = 'cuda_runtime'")
    device = slice_df.filter("category IN ('kernel', 'gpu_memcpy', 'gpu_memset')")
    linked = latest_before(
        device.filter("id % 2 = 0").select("trace_id", "correlation", "ts_ns", "id"),
        launches.select("trace_id", "correlation", "ts_ns", "id"),
        ["trace_id", "correlation"], "ts_ns", F.col("id"), F.col("id"), "slice_out")
    strayed = latest_before(
        device.filter("id % 10 = 3").select("trace_id", "ts_ns", "id"), launches.select("trace_id", "ts_ns", "id"),
        ["trace_id"], "ts_ns", F.col("id"), F.col("id"), "slice_out")
    return (linked.select("trace_id", "slice_out", F.col("id").alias("slice_in"))
            .unionByName(strayed.select("trace_id", "slice_out", F.col("id").alias("slice_in")))
            .filter("slice_out IS NOT NULL"))


def _slots(slice_df: DataFrame) -> DataFrame:
    return slice_df.selectExpr("trace_id", f"(ts_ns - {ORIGIN_NS}) DIV {SLOT_NS} AS slot").distinct()


def windows(slice_df: DataFrame) -> DataFrame:
    """Six-hour windows wherever a trace has slices."""
    return _slots(slice_df).selectExpr(
        "trace_id", "slot AS window_id", "IF(slot % 5 = 0, 'prefill', 'decode') AS stage",
        f"slot * {SLOT_NS} + {ORIGIN_NS} AS start_ns", f"slot * {SLOT_NS} + {ORIGIN_NS + SLOT_NS} AS end_ns")


def window_requests(slice_df: DataFrame, bounds: DataFrame) -> DataFrame:
    """The windows as texts of microseconds from the trace start; some are no numbers, some end before they start, some lie in no trace."""
    relative = windows(slice_df).join(bounds, "trace_id").selectExpr(
        "IF(window_id % 13 = 6, 'run_rank9', trace_id) AS trace_id", "window_id", "stage", "start_ns - trace_start_ns AS a", "end_ns - trace_start_ns AS b")
    text = "concat(IF({0} < 0, '-', ''), abs({0}) DIV 1000, '.', lpad(CAST(abs({0}) % 1000 AS STRING), 3, '0'))"
    return relative.selectExpr(
        "trace_id", "window_id", "stage", f"CASE WHEN window_id % 7 = 3 THEN 'NaN' WHEN window_id % 7 = 5 THEN {text.format('b')} ELSE {text.format('a')} END AS start_us",
        f"IF(window_id % 7 = 5, {text.format('a')}, {text.format('b')}) AS end_us").distinct()


def steps(slice_df: DataFrame) -> DataFrame:
    """Step annotations: five hours out of every six on the first host thread of a trace."""
    return _slots(slice_df).selectExpr(
        "trace_id", f"slot * 4 + CAST(substring(trace_id, 9, 1) AS BIGINT) + {STEP_ID_BASE} AS id",
        "CASE WHEN slot % 11 = 5 THEN 'execute_context_2(64)_generation_3(3)' "
        "WHEN slot % 5 = 0 THEN 'execute_context_1(128)_generation_0(0)' "
        "ELSE 'execute_context_0(0)_generation_1(1)' END AS name",
        "'user_annotation' AS category", f"slot * {SLOT_NS} + {ORIGIN_NS} AS ts_ns", f"{5 * HOUR_NS} AS dur_ns",
        "-1L AS track_id", "concat('1/', substring(trace_id, 9, 1)) AS host_thread")


def forwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-step slices from ``orders``."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('run_rank', o_custkey % 16) AS trace_id", "o_orderkey AS id",
        "IF(o_orderkey % 2 = 0, 'model_forward', 'ModelForward') AS name",
        f"{epoch_ns('o_orderdate')} AS ts_ns", f"{6 * HOUR_NS} AS dur_ns")


def _kernel_name(index: str) -> str:
    return _pick(DEVICE_NAMES, f"({index}) % {len(DEVICE_NAMES)}")


def kernel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated kernel table from ``lineitem`` and ``part``: integer cents of price as time."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS table_id", "l_partkey", "CAST(floor(l_extendedprice * 100D + 0.5D) AS BIGINT) AS cents", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).selectExpr(
        "table_id", f"{_kernel_name('p_partkey + p_size')} AS name", "cents", "l_linenumber").groupBy("table_id", "name").agg(
        F.expr("count(1) AS record_count"), F.expr("sum(cents) AS cents"), F.expr("max(l_linenumber) AS top_line"))


def kernel_table_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the aggregated kernel tables as CSV, one file per table in the order of names: a blank line before every third row, an invalid
    count in every seventh, no name in every eleventh, and rows after the contribution banner."""
    order = Window.partitionBy("table_id").orderBy("name")
    rows = kernel_table(spark, sf_dir).withColumn("n", F.row_number().over(order))
    text = """concat(IF(n % 11 = 0, '', concat('"', name, '"')), ',', IF(n % 7 = 0, 'many', CAST(record_count AS STRING)), ',', CAST(cents AS STRING))"""
    last = rows.groupBy("table_id").agg(F.max("n").alias("n"))
    lines = rows.selectExpr("table_id", "n", f"explode(filter(array(IF(n = 1, 'name,record_count,total_duration_us', NULL), IF(n % 3 = 0, '', NULL), {text}), x -> x IS NOT NULL)) AS value")
    lines = lines.unionByName(last.selectExpr("table_id", "n + 1 AS n", f"explode(array({sql_text(PARTS_BANNER + ',,')}, 'x,1,1')) AS value"))
    (lines.withColumn("_order", F.monotonically_increasing_id()).repartition("table_id").sortWithinPartitions("table_id", "n", "_order")
     .select("table_id", "value").write.partitionBy("table_id").text(folder))


def gemm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark commands from ``part``; every seventh is a comment, every fifth lacks the leading count."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS line", "concat(CASE WHEN p_partkey % 7 = 3 THEN '# ' WHEN p_partkey % 5 = 0 THEN '' ELSE concat(p_size, ' ') END, "
        "'./rocblas-bench -f gemm_ex --transposeA ', IF(p_partkey % 3 = 0, 'T', 'N'), ' --transposeB N -m ', p_size * 128, ' -n ', "
        "p_partkey % 4 + 1, ' -k ', p_size * 64, ' --alpha 1 --a_type bf16_r --lda ', p_size * 128, "
        "' --b_type bf16_r --beta 0 --c_type bf16_r --d_type bf16_r --compute_type f32_r --algo 0') AS text")


def gemm_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark logs from ``lineitem``: three lines per part and line status."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus").agg(
        F.expr("sum(CAST(floor(l_extendedprice * 100D + 0.5D) AS BIGINT)) AS us"),
        F.expr("sum(CAST(l_quantity AS BIGINT)) * 1000 AS gflops"), F.expr("max(l_linenumber) AS top"))
    entry = "named_struct('line_no', {n}, 'text', {t})"
    rows = [entry.format(n=1, t="'[0]:transA,transB,m,n,hipblaslt-Gflops,us'"),
            entry.format(n=2, t="concat(IF(top % 2 = 0, '    ', ''), 'T,N,0,1,128,', gflops, ', ', us)"),
            entry.format(n=3, t="CASE WHEN top = 7 THEN '--Solution index: 1' WHEN top % 2 = 0 THEN "
                                "concat('    --kernel name:    Cijk_Alik_Bljk_MT', top, 'x16') ELSE "
                                "concat('run Cijk_first Solution::Alik_', top, ' end') END")]
    return sums.selectExpr("l_partkey AS line", "IF(l_linestatus = 'F', 'baseline', 'optimized') AS variant",
                           f"inline(array({', '.join(rows)}))")


def monitor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor snapshots in CSV form: a card per part, a node per part size, a process per order."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    cards = parts.selectExpr(
        "p_size AS node", "p_partkey AS line_no", "concat(p_partkey, ', GPU-', p_partkey, ', 0000:', p_partkey, ', ', "
        "IF(p_partkey % 2 = 0, 0, p_size * 10), ', 32768, ', p_partkey % 3 * 40) AS text")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    running = orders.join(parts, orders["o_custkey"] == parts["p_partkey"]).selectExpr(
        "p_size AS node", "inline(array(named_struct('line_no', 1000000000000 + 1 + o_orderkey, 'text', "
        "concat(o_orderkey, ', ', IF(o_orderkey % 9 = 0, '[Not Supported]', concat('worker_', o_orderstatus)))), "
        "named_struct('line_no', 2000000000000 + 1 + o_orderkey, 'text', concat('GPU-', p_partkey, ', ', o_orderkey, ', ', o_orderkey % 512))))")
    marks = parts.select("p_size").distinct().selectExpr(
        "p_size AS node", "inline(array(named_struct('line_no', 1000000000000, 'text', '===NAMES==='), "
        "named_struct('line_no', 2000000000000, 'text', '===APPS===')))")
    return cards.unionByName(running).unionByName(marks)


def pid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process owners from ``orders``; expensive ones carry no process id and stay unknown."""
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return orders.join(parts, orders["o_custkey"] == parts["p_partkey"]).selectExpr(
        "p_size AS node", "IF(o_totalprice < 400000, o_orderkey, NULL) AS pid", "CASE o_orderstatus WHEN 'F' THEN 'MAP' WHEN 'O' THEN 'HOST' ELSE 'GONE' END AS tag",
        "concat('serve_', o_orderkey % 5) AS container")


def phase_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase annotations from ``orders``: five days each, on seven threads of four traces."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('run_rank', o_custkey % 4) AS trace_id", "o_orderkey AS id",
        "concat('PHASE_GRAPH step=', o_orderkey, IF(o_orderkey % 13 = 0, '', concat(' phase=', lower(o_orderstatus))), ' tokens=', o_custkey, "
        "IF(o_orderkey % 2 = 0, concat(' padded=', o_custkey + 1), ''), ' mode=', substring(o_orderpriority, 3), "
        "' computed=[', o_custkey, ',', o_orderkey, '] prompt=[', o_orderkey, ']') AS name",
        f"{epoch_ns('o_orderdate')} AS ts_ns", f"{120 * HOUR_NS} AS dur_ns", "'1' AS pid", "CAST(o_custkey % 7 AS STRING) AS tid")


def launch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime calls from ``lineitem`` for the phase annotations."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('run_rank', l_partkey % 4) AS trace_id", "l_orderkey * 8 + l_linenumber AS id",
        "element_at(array('cudaGraphLaunch', 'sdaaGraphLaunch_v2', 'cudaLaunchKernel', 'hipGraphLaunch', 'cudaGraphLaunchExt'), "
        "CAST(l_suppkey % 5 + 1 AS INT)) AS name", f"{epoch_ns('l_shipdate')} AS ts_ns", "'1' AS pid", "CAST(l_orderkey % 7 AS STRING) AS tid")


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator dump cases from ``lineitem``: parameters repeat across rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) AS operator", "l_orderkey * 8 + l_linenumber AS dump_id", f"{epoch_ns('l_shipdate')} AS ts_ns",
        "concat(CAST(l_quantity AS INT), '/', CAST(round(l_discount * 100) AS INT), '/', CAST(round(l_tax * 100) AS INT)) AS content")
