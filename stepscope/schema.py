"""Schemas of the stored tables."""

EVENT_FIELDS = ("ph STRING, cat STRING, name STRING, pid STRING, tid STRING, ts DECIMAL(22,3), dur DECIMAL(22,3), "
                "id STRING, bp STRING, args MAP<STRING,STRING>")
# A document is an object around events, a list of events, or one event.
DOCUMENT = f"traceEvents ARRAY<STRUCT<{EVENT_FIELDS}>>, events ARRAY<STRUCT<{EVENT_FIELDS}>>, {EVENT_FIELDS}"
TRACE_EVENT = ("trace_id STRING, ord BIGINT, ph STRING, cat STRING, name STRING, pid STRING, tid STRING, ts_us DECIMAL(22,3), "
               "dur_us DECIMAL(22,3), flow_id STRING, bp STRING, args MAP<STRING,STRING>")
