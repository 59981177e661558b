"""The driver views of ``driver_views`` as DuckDB common table expressions."""
from __future__ import annotations

from ..fixed_values import DEVICE_NAMES
from .driver_views import (CPU_OP_NAMES, FRAME_NAMES, HOUR_NS, ORIGIN_NS, RUNTIME_NAMES, SLOT_NS,
                           STEP_ID_BASE)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


V_SLICE = f"""
base AS (
  SELECT event_id AS id, user_id, event_type, epoch_us(ts) * 1000 AS ts_ns,
         CAST(floor(value * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS c,
         regexp_extract(props, '([0-9]+)', 1) AS correlation,
         CASE event_type WHEN 'purchase' THEN 'kernel' WHEN 'click' THEN 'gpu_memcpy' WHEN 'error' THEN 'gpu_memset'
              WHEN 'signup' THEN 'cuda_runtime'
              ELSE CASE WHEN event_id % 2 = 0 THEN 'cpu_op' ELSE 'python_function' END END AS category
  FROM events),
v_slice AS (
  SELECT 'run_rank' || (user_id % 4) AS trace_id, id,
    CASE WHEN category IN ('kernel','gpu_memcpy','gpu_memset')
           THEN ({text_list(DEVICE_NAMES)})[(id * 7 + CAST(correlation AS BIGINT)) % {len(DEVICE_NAMES)} + 1]
         WHEN category = 'cuda_runtime' THEN ({text_list(RUNTIME_NAMES)})[id % 4 + 1]
         WHEN category = 'cpu_op' THEN ({text_list(CPU_OP_NAMES)})[id % 5 + 1]
         ELSE ({text_list(FRAME_NAMES)})[id % 3 + 1] END AS name,
    category, ts_ns,
    CASE WHEN category IN ('kernel','gpu_memcpy','gpu_memset') THEN c * 600000000
         WHEN category = 'cuda_runtime' THEN 1000000000 ELSE c * 2400000000 END AS dur_ns,
    user_id AS track_id, '1' AS pid, CAST(user_id % 8 AS VARCHAR) AS tid, '1/' || (user_id % 8) AS host_thread,
    correlation,
    CASE WHEN category IN ('kernel','gpu_memcpy','gpu_memset') AND id % 4 <> 0 THEN NULL
         WHEN category = 'cuda_runtime' AND id % 3 <> 0 THEN NULL
         WHEN category = 'python_function' THEN NULL ELSE 'x' || correlation END AS external_id,
    CASE WHEN category IN ('kernel','gpu_memcpy','gpu_memset') THEN '0' END AS device,
    CASE WHEN category IN ('kernel','gpu_memcpy','gpu_memset') THEN CAST(user_id % 3 AS VARCHAR) END AS stream
  FROM base),
v_device AS (SELECT * FROM v_slice WHERE category IN ('kernel','gpu_memcpy','gpu_memset')),
v_runtime AS (SELECT * FROM v_slice WHERE category = 'cuda_runtime')"""

V_FLOW = """
v_flow AS (
  SELECT d.trace_id, r.id AS slice_out, d.id AS slice_in
  FROM (SELECT * FROM v_device WHERE id % 2 = 0) d ASOF JOIN v_runtime r
    ON d.trace_id = r.trace_id AND d.correlation = r.correlation AND d.ts_ns >= r.ts_ns
  UNION ALL
  SELECT d.trace_id, r.id, d.id
  FROM (SELECT * FROM v_device WHERE id % 10 = 3) d ASOF JOIN v_runtime r
    ON d.trace_id = r.trace_id AND d.ts_ns >= r.ts_ns)"""

V_SLOT = f"""
v_slot AS (SELECT DISTINCT trace_id, (ts_ns - {ORIGIN_NS}) // {SLOT_NS} AS slot FROM v_slice)"""

V_WINDOW = V_SLOT + f""",
v_window AS (
  SELECT trace_id, slot AS window_id, CASE WHEN slot % 5 = 0 THEN 'prefill' ELSE 'decode' END AS stage,
         slot * {SLOT_NS} + {ORIGIN_NS} AS start_ns, slot * {SLOT_NS} + {ORIGIN_NS + SLOT_NS} AS end_ns
  FROM v_slot)"""

V_STEP = f"""
v_step AS (
  SELECT trace_id, slot * 4 + CAST(substr(trace_id, 9, 1) AS BIGINT) + {STEP_ID_BASE} AS id,
    CASE WHEN slot % 11 = 5 THEN 'execute_context_2(64)_generation_3(3)'
         WHEN slot % 5 = 0 THEN 'execute_context_1(128)_generation_0(0)'
         ELSE 'execute_context_0(0)_generation_1(1)' END AS name,
    slot * {SLOT_NS} + {ORIGIN_NS} AS ts_ns, {5 * HOUR_NS} AS dur_ns, '1/' || substr(trace_id, 9, 1) AS host_thread
  FROM v_slot)"""

V_FORWARD = f"""
v_forward AS (
  SELECT 'run_rank' || (o_custkey % 16) AS trace_id, o_orderkey AS id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'model_forward' ELSE 'ModelForward' END AS name,
         epoch_us(o_orderdate) * 1000 AS ts_ns, {6 * HOUR_NS} AS dur_ns
  FROM orders)"""
