"""Phase annotations: parsed fields, launches inside scopes, and dump cases of a request interval."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import GRAPH_LAUNCH_API
from ..functions.layout import latest_before, ordered_index
from .classify import sql_text

REQUIRED = ["step", "phase", "tokens", "mode"]


def phase_fields(scopes: DataFrame, prefix: str = "PHASE_GRAPH") -> DataFrame:
    """Fields of ``PREFIX key=value …`` names; ``error_code`` marks names without the required ones."""
    pairs = r"regexp_extract_all(name, '(\\w+=(?:\\[[^\\]]*\\]|\\S+))', 1)"
    parsed = scopes.filter(f"startswith(name, {sql_text(prefix + ' ')})").withColumn("_f", F.expr(
        f"transform({pairs}, p -> struct(substring_index(p, '=', 1) AS k, substring(p, length(substring_index(p, '=', 1)) + 2) AS v))"))
    value = "try_element_at(filter(_f, e -> e.k = '{k}'), -1).v"
    missing = " OR ".join(f"{value.format(k=k)} IS NULL" for k in REQUIRED)
    return parsed.selectExpr(
        *[f"`{c}`" for c in scopes.columns],
        f"try_cast({value.format(k='step')} AS BIGINT) AS step", f"{value.format(k='phase')} AS phase",
        f"try_cast({value.format(k='tokens')} AS BIGINT) AS tokens", f"{value.format(k='mode')} AS mode",
        f"try_cast({value.format(k='padded')} AS BIGINT) AS padded",
        f"from_json({value.format(k='computed')}, 'array<bigint>') AS computed",
        f"from_json({value.format(k='prompt')}, 'array<bigint>') AS prompt",
        f"IF({missing}, 'missing_fields', NULL) AS error_code")


def graph_launches(slices: DataFrame) -> DataFrame:
    """Calls of a vendor's graph-launch function."""
    return slices.filter(f"name RLIKE {sql_text(GRAPH_LAUNCH_API)}")


def launch_counts(scopes: DataFrame, launches: DataFrame) -> DataFrame:
    """Launches that start inside each scope on its thread.

    Launches are numbered per thread once; a scope's count is the difference of the numbers reached just
    before its end and its start, so no scope meets its launches one by one.
    """
    keys = ["trace_id", "pid", "tid"]
    numbered = ordered_index(launches.select(*keys, "ts_ns", "id"), keys, "ts_ns", ["id"])
    edges = scopes.selectExpr(*keys, "id AS scope_id", "inline(array(named_struct('edge', 0, 'ts_ns', ts_ns - 1), "
                                                       "named_struct('edge', 1, 'ts_ns', ts_ns + greatest(dur_ns, 0L) - 1)))")
    reached = latest_before(edges, numbered.select(*keys, "ts_ns", "idx"), keys, "ts_ns", F.col("idx") + 1, F.col("idx"), "reached")
    return reached.groupBy("trace_id", "scope_id").agg(
        F.expr("sum(IF(edge = 1, coalesce(reached, 0L), -coalesce(reached, 0L))) AS graph_launches"))


def distinct_dumps(dumps: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Dump cases ``(operator, dump_id, ts_ns, content)`` of a request interval, one per operator and content."""
    return dumps.filter(f"ts_ns >= {start_ns} AND ts_ns <= {end_ns}").groupBy("operator", F.sha2("content", 256).alias("content_hash")).agg(
        F.expr("min(dump_id) AS representative"), F.expr("count(1) AS copies"))


def dump_counts(distinct: DataFrame) -> DataFrame:
    """Dump counts per operator before and after removing repeats."""
    return distinct.groupBy("operator").agg(F.expr("sum(copies) AS before_count"), F.expr("count(1) AS after_count"))
