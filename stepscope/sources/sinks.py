"""Report sinks: table sets as Parquet, CSV or JSON lines, and text summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import shortened

CELL_LIMIT = 32_000


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that hold text only."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def short_cells(df: DataFrame) -> DataFrame:
    """Text columns cut to what a spreadsheet cell can hold; meant for spreadsheet copies only."""
    return df.select(*[shortened(F.col(f.name), CELL_LIMIT, "... [truncated]").alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


def write_report(tables: dict[str, DataFrame], folder: str, sources: list[str] = (), fmt: str = "parquet", overwrite: bool = False) -> None:
    """Write each table under the folder. Existing outputs are kept unless overwriting is asked for;
    a source is never written to."""
    target = folder.rstrip("/")
    for source in sources:
        if f"{source.rstrip('/')}/".startswith(f"{target}/") or f"{target}/".startswith(f"{source.rstrip('/')}/"):
            raise ValueError("report output must differ from its source")
    mode = "overwrite" if overwrite else "errorifexists"
    for name, df in tables.items():
        out = flat_columns(df) if fmt == "csv" else df
        writer = out.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{target}/{name}")


def summary_text(summary: DataFrame) -> DataFrame:
    """Category rows as text lines."""
    return summary.select("trace_id", "window_id", "category_ord", F.format_string(
        "%s: %.6f ms, %s%%", "category", F.col("total_duration_us") / 1000.0,
        F.coalesce(F.format_string("%.4f", "kernel_relative_pct"), F.lit("n.a."))).alias("line"))
