"""Row filters over slices: device events, host calls and markers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEVICE_CATEGORIES, HOST_CATEGORIES, PHASE_KEYWORDS, WINDOW_CATEGORIES
from ..functions.expressions import contains_any, is_runtime


def check_device_categories(categories: Sequence[str]) -> list[str]:
    """Distinct device categories in given order; host, runtime and driver categories are refused."""
    ordered = list(dict.fromkeys(c.strip() for c in categories))
    lowered = [c.lower() for c in ordered]
    if not ordered or any("runtime" in c or "driver" in c or c in HOST_CATEGORIES for c in lowered):
        raise ValueError("device categories cannot include host, runtime or driver events")
    return ordered


def window_events(slices: DataFrame, extra: Sequence[str] = (), device_id: str | None = None,
                  track_ids: Sequence[int] = ()) -> DataFrame:
    """Device events of the window report: exact category names, optional device and track scope."""
    kept = slices.filter(F.col("category").isin(check_device_categories([*WINDOW_CATEGORIES, *extra])))
    if device_id is not None:
        kept = kept.filter(F.col("device") == str(device_id))
    return kept.filter(F.col("track_id").isin(list(track_ids))) if track_ids else kept


def complete(slices: DataFrame) -> DataFrame:
    """Finished events: a complete phase (or none given), a time and a positive duration."""
    finished = F.col("ts_ns").isNotNull() & (F.col("dur_ns") > 0)
    if "ph" in slices.columns:
        finished = finished & (F.coalesce(F.col("ph"), F.lit("X")) == "X")
    return slices.filter(finished)


def device_events(slices: DataFrame, extra: Sequence[str] = (), pid: str | None = None,
                  device: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Device events of the paired report: any letter case, optionally one process, device and window
    that holds the whole event. Markers stay; drop them by category after naming."""
    categories = check_device_categories([*DEVICE_CATEGORIES, *[c.lower() for c in extra]])
    kept = complete(slices).filter(F.lower("category").isin(categories))
    if pid is not None:
        kept = kept.filter(F.col("pid") == str(pid))
    if device is not None:
        kept = kept.filter(F.col("device") == str(device))
    if start_ns is not None and end_ns is not None:
        kept = kept.filter((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") + F.col("dur_ns") <= end_ns))
    return kept


def device_identities(events: DataFrame) -> DataFrame:
    """Devices and processes per trace; ``error_code`` marks a trace that needs a device choice."""
    identity = F.concat_ws("|", F.coalesce("pid", F.lit("?")), F.coalesce("device", F.lit("?")))
    return events.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min(identity).alias("first_identity"),
        F.max(identity).alias("last_identity")).withColumn(
        "error_code", F.when(F.col("first_identity") != F.col("last_identity"), "multiple_devices"))


def phase_event(category: Column, name: Column) -> Column:
    """Device event, or a host operator named like device work (the phase report's selection)."""
    return category.isin(WINDOW_CATEGORIES) | ((category == "cpu_op") & contains_any(name, PHASE_KEYWORDS))


def runtimes(slices: DataFrame) -> DataFrame:
    return slices.filter(is_runtime(F.col("category")))


def host_identity() -> Column:
    """Host thread, or the track where the thread is unknown."""
    return F.coalesce(F.concat(F.lit("thread:"), F.col("host_thread")),
                      F.concat(F.lit("track:"), F.col("track_id").cast("string")))
