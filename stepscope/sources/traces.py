"""Trace documents to stored event, slice, flow and bounds tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import attribute, correlation, external_id, rank_of
from ..functions.layout import enclosure_join, latest_before, ordered_index
from ..schema import DOCUMENT, EVENT_FIELDS
from . import documents

EVENT_COLUMNS = ["ph", "cat", "name", "pid", "tid", "ts", "dur", "id", "bp", "args"]
EVENT_FIELDS_OF = ["e.ph AS ph", "e.cat AS cat", "e.name AS name", "e.pid AS pid", "e.tid AS tid", "e.ts AS ts_us", "e.dur AS dur_us",
                   "e.id AS flow_id", "e.bp AS bp", "e.args AS args"]
NO_FIELDS = " AND ".join(f"{c} IS NULL" for c in ("ph", "cat", "name", "pid", "tid", "ts_us", "dur_us", "flow_id", "bp", "args"))


def read_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``trace_event`` rows of JSON documents, plain or gzip, one trace per file, each parsed whole by Spark.

    One schema covers the object, list and single-event roots; unknown fields are skipped while parsing. A document that cannot be
    parsed is read again event by event: it comes out as in :func:`read_large_traces`, with one event without fields, see :func:`trace_errors`.
    """
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(paths).select(
        F.col("_metadata.file_path").alias("trace_id"), F.monotonically_increasing_id().alias("_row"), "*")
    unread = " AND ".join(f"{c} IS NULL" for c in ("traceEvents", "events", *EVENT_COLUMNS))
    single = f"array(struct({', '.join(EVENT_COLUMNS)}))"
    sound = raw.filter(f"NOT ({unread}) AND _row >= 0").selectExpr("trace_id", "_row", f"posexplode(coalesce(traceEvents, events, {single})) AS (_pos, e)")
    # The row number keeps the condition out of the parser, which would skip documents by their first fields.
    broken = raw.filter(f"{unread} AND _row >= 0").select(F.col("trace_id").alias("path")).distinct()
    return sound.selectExpr("trace_id", "pmod(_row, 8589934592L) + _pos AS ord", *EVENT_FIELDS_OF).unionByName(_events_of(documents.reread(broken)))


def read_large_traces(spark: SparkSession, paths: str | list[str], split_bytes: int = documents.SPLIT) -> DataFrame:
    """``trace_event`` rows of documents of any size: each is cut into ranges of ``split_bytes`` that tasks read on their own.

    Documents that are cut keep the events before the cut, and defects inside an event leave the others. Attributes
    that are objects or lists are their JSON text, in which the readers may differ in blanks. See :mod:`.documents`.
    """
    return _events_of(documents.split_documents(documents.listed(spark, paths), split_bytes))


def event_counts(events: DataFrame) -> DataFrame:
    """``trace_id, event_count`` as a loader announces it: every event of a document, a defect is none."""
    return events.groupBy("trace_id").agg(F.expr(f"count_if(NOT ({NO_FIELDS}))").alias("event_count"))


def _events_of(texts: DataFrame) -> DataFrame:
    parsed = texts.select(F.col("path").alias("trace_id"), "ord", F.from_json("text", EVENT_FIELDS).alias("e"))
    return parsed.selectExpr("trace_id", "ord", *EVENT_FIELDS_OF)


def trace_errors(events: DataFrame) -> DataFrame:
    """``trace_id, error_code`` of documents that could not be read, or not to their end.

    Both readers leave one event without any field for such a document. Spark lists no empty files, so these are no documents.
    """
    return (events.groupBy("trace_id").agg(F.expr(f"count_if({NO_FIELDS}) AS bad"), F.expr("count(1) AS n")).filter("bad > 0")
            .selectExpr("trace_id", "IF(bad = n, 'unreadable_document', 'truncated_document') AS error_code"))


def slices(events: DataFrame) -> DataFrame:
    """``slice`` rows of complete events, in integer nanoseconds; attributes read by normalised key.

    Unfinished events keep a negative duration for the callers that must report them.
    """
    complete = events.filter("coalesce(ph, 'X') = 'X' AND ts_us IS NOT NULL")
    args = F.col("args")
    return complete.select(
        "trace_id", F.col("ord").alias("id"), "name", F.col("cat").alias("category"),
        (F.col("ts_us") * 1000).cast("bigint").alias("ts_ns"), (F.coalesce("dur_us", F.lit(0)) * 1000).cast("bigint").alias("dur_ns"),
        F.xxhash64("pid", "tid").alias("track_id"), "pid", "tid",
        F.concat_ws("/", F.coalesce("pid", F.lit("None")), F.coalesce("tid", F.lit("None"))).alias("host_thread"),
        correlation(args).alias("correlation"), external_id(args).alias("external_id"),
        attribute(args, "device", "device_id").alias("device"), attribute(args, "stream", "stream_id").alias("stream"),
        attribute(args, "Call stack", "Python stack", "stack").alias("call_stack"), "ph",
        _list_item("Concrete Inputs", 8).alias("norm_mode"), _list_item("Input type", 6).alias("gate_type"))


def _list_item(key: str, index: int):
    values = F.from_json(F.try_element_at(F.col("args"), F.lit(key)), "array<string>")
    return F.try_element_at(values, F.lit(index + 1))


def flows(events: DataFrame, slice_df: DataFrame) -> DataFrame:
    """``flow`` edges between the slices that flow events bind to, along each flow id.

    Starts, steps and finishes marked ``bp=e`` bind to the innermost slice around them; other finishes
    bind to the next slice of their thread. Flow events without an id belong to no chain.
    """
    keys = ["trace_id", "host_thread"]
    points = events.filter("ph IN ('s', 't', 'f') AND flow_id IS NOT NULL").selectExpr(
        "trace_id", "concat_ws('/', coalesce(pid, 'None'), coalesce(tid, 'None')) AS host_thread", "cat", "name", "flow_id", "ord",
        "CAST(ts_us * 1000 AS BIGINT) AS at", "ph = 'f' AND coalesce(bp, '') <> 'e' AS forward")
    spans = slice_df.selectExpr(*keys, "id AS slice_id", "ts_ns AS start", "ts_ns + greatest(dur_ns, 1L) AS end", "dur_ns")
    around = enclosure_join(points.filter("NOT forward"), spans, keys, "at", "start", "end").groupBy(
        "trace_id", "cat", "name", "flow_id", "ord", "at").agg(F.expr("min_by(slice_id, struct(dur_ns, slice_id)) AS slice_id"))
    following = latest_before(
        points.filter("forward").selectExpr("*", "-at AS back"), spans.selectExpr(*keys, "-start AS back", "slice_id"), keys, "back",
        F.col("slice_id"), -F.col("slice_id"), "slice_id").select("trace_id", "cat", "name", "flow_id", "ord", "at", "slice_id")
    bound = around.unionByName(following).filter("slice_id IS NOT NULL")
    chain = ordered_index(bound.fillna("", ["cat", "name"]), ["trace_id", "cat", "name", "flow_id"], "at", ["ord"], ["slice_id"])
    return chain.filter("next_row IS NOT NULL").selectExpr("trace_id", "slice_id AS slice_out", "next_row.slice_id AS slice_in")


def store(events: DataFrame, path: str, overwrite: bool = False) -> None:
    """Land events as Parquet, clustered by trace and time so that readers skip by both."""
    (events.repartitionByRange("trace_id", "ts_us").sortWithinPartitions("trace_id", "ts_us")
     .write.mode("overwrite" if overwrite else "errorifexists").parquet(path))


def trace_files(events: DataFrame) -> DataFrame:
    """Files with their rank."""
    return events.select("trace_id").distinct().withColumn("rank", rank_of(F.col("trace_id")))


def single_trace_groups(files: DataFrame) -> DataFrame:
    """Directories with their trace count; more than one trace is refused rather than merged."""
    folder = F.regexp_replace("trace_id", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.countDistinct("trace_id").alias("trace_count"), F.min("trace_id").alias("trace_id")) \
        .withColumn("error_code", F.expr("IF(trace_count > 1, 'several_traces', NULL)"))
