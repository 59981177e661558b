"""Small slice tables for tests."""
SLICE = ("trace_id STRING, id BIGINT, name STRING, category STRING, ts_ns BIGINT, dur_ns BIGINT, track_id BIGINT, pid STRING, tid STRING, "
         "host_thread STRING, correlation STRING, external_id STRING, device STRING, stream STRING, norm_mode STRING, gate_type STRING")
COLUMNS = [c.split()[0] for c in SLICE.split(", ")]


def row(id, name, category, ts, dur, **more):
    base = dict(trace_id="t", id=id, name=name, category=category, ts_ns=ts, dur_ns=dur, track_id=0, pid="1", tid="1")
    base.update(more)
    base.setdefault("host_thread", f"{base['pid']}/{base['tid']}")
    return tuple(base.get(c) for c in COLUMNS)


def slices(spark, *rows):
    return spark.createDataFrame(list(rows), SLICE)


def flows(spark, *edges):
    return spark.createDataFrame([("t", a, b) for a, b in edges], "trace_id STRING, slice_out BIGINT, slice_in BIGINT")


def window(spark, start, end, stage="decode"):
    return spark.createDataFrame([("t", 1, stage, start, end)], "trace_id STRING, window_id BIGINT, stage STRING, start_ns BIGINT, end_ns BIGINT")
