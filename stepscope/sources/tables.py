"""Aggregated tables, run configurations, benchmark files and monitor snapshots."""
from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import ordered_index

# Row that starts the contribution section of an exported kernel table (fixed value).
PARTS_BANNER = "分类分项（逐次调用来源，分类汇总引用本表；上方保留原SQL聚合）"
ALIASES = {"name": ["kernel_name", "name"], "duration_us": ["total_duration_us", "duration_us"],
           "record_count": ["call_count", "record_count", "count"]}
RAW_COLUMNS = ["name", "record_count", "total_duration_us", "avg_duration_us", "kernel_relative_pct", "window_absolute_pct"]


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """CSV or TSV table with a header in its first line, as text columns with ``_file`` and ``_line``, the physical line counted from 1.

    Blank lines are rows without values, so that they count. Files are split like any text: lines are numbered over the splits of a file.
    """
    separator = separator or ("\t" if path.lower().rstrip("/").endswith(".tsv") else ",")
    lines = spark.read.text(path).select(F.col("value").alias("_text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    first = lines.filter("_split = 0").first()  # the first line of a file; all files have one header
    if first is None:
        raise ValueError(f"no table in {path}")
    names = [name.strip() for name in next(csv.reader([first[0].lstrip("\ufeff")], delimiter=separator))]
    schema = ", ".join(f"`{name or f'_c{i}'}` STRING" for i, name in enumerate(names))
    numbered = ordered_index(lines.withColumn("_order", F.monotonically_increasing_id()), ["_file"], "_split", ["_order"]).filter("idx > 0")
    return numbered.select(F.from_csv("_text", schema, {"sep": separator}).alias("_row"), "_file", (F.col("idx") + 1).alias("_line")).select("_row.*", "_file", "_line")


def kernel_names(table: DataFrame) -> DataFrame:
    """Name, count and time of an audit table under any of their usual column names; a missing count is 1."""
    def pick(target: str, default: str) -> str:
        present = [c for c in ALIASES[target] if c in table.columns][:1]
        return f"coalesce(nullif({present[0]}, ''), '{default}')" if present else f"'{default}'"

    named = pick("name", "")
    return table.filter(f"{named} <> ''").selectExpr(
        f"{named} AS name", f"CAST({pick('record_count', '1')} AS BIGINT) AS record_count", f"CAST({pick('duration_us', '0')} AS DOUBLE) AS duration_us")


def raw_kernel_rows(table: DataFrame) -> DataFrame:
    """Raw columns of an exported kernel table with their source row; ends at the contribution section.

    ``error_code`` marks rows without a name or with an invalid count or time.
    """
    for column in ("name", "record_count", "total_duration_us"):
        if column not in table.columns:
            raise ValueError(f"kernel table lacks the column {column}")
    banner = table.groupBy("_file").agg(F.min(F.when(F.col("name") == PARTS_BANNER, F.col("_line"))).alias("_stop"))
    kept = table.join(banner, "_file").filter("_stop IS NULL OR _line < _stop")
    filled = " OR ".join(f"coalesce(`{c}`, '') <> ''" for c in table.columns if not c.startswith("_"))
    numbers = [f"try_cast({c} AS {'BIGINT' if c == 'record_count' else 'DOUBLE'}) AS {c}" if c in table.columns
               else f"CAST(NULL AS DOUBLE) AS {c}" for c in RAW_COLUMNS[1:]]
    rows = kept.filter(filled).selectExpr("_file AS table_id", "_line AS source_row", "name", *numbers)
    return rows.withColumn("error_code", F.expr(
        "CASE WHEN coalesce(name, '') = '' THEN 'missing_name' WHEN record_count IS NULL OR record_count <= 0 OR total_duration_us IS NULL "
        "OR isnan(total_duration_us) OR total_duration_us < 0 OR total_duration_us = double('Infinity') THEN 'invalid_number' END"))


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """Run configuration pairs as rows ``(trace_id, side, field, value)``; values are JSON text."""
    raw = spark.read.schema("mapping MAP<STRING,STRING>, formal MAP<STRING,STRING>").option("multiLine", True).json(path).select(
        F.col("_metadata.file_path").alias("trace_id"), "mapping", "formal")
    sides = raw.selectExpr("trace_id", "inline(array(struct('mapping' AS side, mapping AS kv), struct('formal' AS side, formal AS kv)))")
    return sides.selectExpr("trace_id", "side", "explode(kv) AS (field, value)")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, text)``; commands, logs and snapshots are small files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.selectExpr("file", r"posexplode(split(value, '\r?\n')) AS (line_no, text)")


def case_lines(lines: DataFrame) -> DataFrame:
    """Commands of a case file numbered from 1, blank and comment lines aside."""
    kept = lines.filter(r"text RLIKE '\\S' AND NOT text RLIKE '^\\s*#'")
    return ordered_index(kept, ["file"], "line_no").selectExpr("file", "idx + 1 AS line", "text")


def log_lines(lines: DataFrame) -> DataFrame:
    """Log lines with case number and variant from paths like ``…/baseline/line_3_….log``."""
    return lines.selectExpr(
        r"CAST(nullif(regexp_extract(file, 'line_(\\d+)_', 1), '') AS BIGINT) AS line",
        r"nullif(regexp_extract(file, '(baseline|optimized)(?:_kernel)?/[^/]*$', 1), '') AS variant", "line_no", "text")
