"""Window selection: events that start in a window, carry-in events and whole containment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ns_to_us, us_to_ns
from ..functions.layout import enclosure_join

WINDOW_KEYS = ["trace_id", "window_id"]


def relative_windows(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Windows from microsecond texts relative to the trace start; ``error_code`` marks invalid ones."""
    joined = requests.join(bounds, "trace_id", "left").select(
        requests["*"], "trace_start_ns", "trace_end_ns",
        us_to_ns(F.col("start_us")).alias("_a"), us_to_ns(F.col("end_us")).alias("_b"))
    return joined.withColumn(
        "error_code",
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "invalid_time")
        .when(F.col("_a") >= F.col("_b"), "empty_window")
        .when(F.col("trace_start_ns").isNull(), "unknown_trace")
        .when(F.col("_b") > F.col("trace_end_ns") - F.col("trace_start_ns"), "beyond_trace_bounds")
    ).withColumn("start_ns", F.col("trace_start_ns") + F.col("_a")).withColumn(
        "end_ns", F.col("trace_start_ns") + F.col("_b")).drop("_a", "_b")


def trace_bounds(slices: DataFrame) -> DataFrame:
    return slices.groupBy("trace_id").agg(
        F.min("ts_ns").alias("trace_start_ns"),
        F.max(F.col("ts_ns") + F.greatest(F.col("dur_ns"), F.lit(0))).alias("trace_end_ns"))


def started_in(events: DataFrame, windows: DataFrame, width: Column | None = None) -> DataFrame:
    """Events whose start lies in a window, with full duration."""
    spans = windows.select("trace_id", "window_id", "start_ns", "end_ns")
    return enclosure_join(events, spans, ["trace_id"], "ts_ns", "start_ns", "end_ns", width)


def carried_in(events: DataFrame, windows: DataFrame, width: Column | None = None) -> DataFrame:
    """Events that started before a window and are still running at its start."""
    starts = windows.select("trace_id", "window_id", "start_ns", "end_ns")
    open_from = events.selectExpr("*", "ts_ns + 1 AS _from", "ts_ns + dur_ns AS _to")
    return enclosure_join(starts, open_from, ["trace_id"], "start_ns", "_from", "_to", width).drop("_from", "_to")


def contained_in(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that lie in a window as a whole."""
    return started_in(events, windows).filter(F.col("ts_ns") + F.col("dur_ns") <= F.col("end_ns"))


def window_metadata(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Selected events, events past the end, tracks and summed time per window.

    ``error_code`` marks windows without events or with unfinished events.
    """
    stats = started_in(events, windows).groupBy(*WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("selected_event_count"),
        F.count_if(F.col("ts_ns") + F.col("dur_ns") > F.col("end_ns")).alias("events_crossing_end"),
        F.count_if(F.col("dur_ns") < 0).alias("unfinished_events"),
        F.countDistinct("track_id").alias("track_count"), F.sum("dur_ns").alias("selected_duration_ns"))
    joined = windows.join(stats, WINDOW_KEYS, "left")
    return joined.select(
        *WINDOW_KEYS, "stage", "start_ns", "end_ns",
        ns_to_us(F.col("end_ns") - F.col("start_ns")).alias("window_duration_us"),
        F.coalesce("selected_event_count", F.lit(0)).alias("selected_event_count"),
        F.coalesce("events_crossing_end", F.lit(0)).alias("events_crossing_end"),
        F.coalesce("track_count", F.lit(0)).alias("track_count"),
        ns_to_us(F.coalesce("selected_duration_ns", F.lit(0))).alias("selected_total_duration_us"),
        F.when(F.coalesce("selected_event_count", F.lit(0)) == 0, "no_device_events")
        .when(F.col("unfinished_events") > 0, "unfinished_events").alias("error_code"))


def request_metadata(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested windows, see :func:`relative_windows`, with relative and absolute bounds, what they select and the tracks it lies on.

    ``error_code`` also marks windows without events or with unfinished ones; only windows without any may be reported.
    """
    valid = requests.filter("error_code IS NULL").select(*WINDOW_KEYS, "start_ns", "end_ns")
    stats = started_in(events, valid).groupBy(*WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("selected_event_count"), F.count_if(F.col("ts_ns") + F.col("dur_ns") > F.col("end_ns")).alias("events_crossing_end"),
        F.count_if(F.col("dur_ns") < 0).alias("_unfinished"), F.array_sort(F.collect_set("track_id")).alias("track_ids"))
    joined = requests.join(stats, WINDOW_KEYS, "left")
    known = F.col("error_code").isNull()
    return joined.select(
        *WINDOW_KEYS, "stage", "start_us", "end_us", "trace_start_ns", F.when(known, F.col("start_ns") - F.col("trace_start_ns")).alias("start_offset_ns"),
        F.when(known, F.col("end_ns") - F.col("trace_start_ns")).alias("end_offset_ns"), F.when(known, F.col("start_ns")).alias("start_ns"),
        F.when(known, F.col("end_ns")).alias("end_ns"), "selected_event_count", "events_crossing_end", "track_ids",
        F.when(~known, F.col("error_code")).when(F.col("selected_event_count").isNull(), "no_device_events")
        .when(F.col("_unfinished") > 0, "unfinished_events").alias("error_code"))
