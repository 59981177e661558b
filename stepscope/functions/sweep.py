"""Least enclosing intervals of points, found without listing the pairs of points and intervals.

On a busy thread the intervals around a point grow with the density of the trace, so the pairs grow with its square. Here points and
intervals are dealt by (keys, cut of the time axis) and each cut is read once in the order of time: open intervals lie in heaps, and a
point takes the few it asks for. Shuffled rows grow with points and intervals, a task holds the open intervals of one cut.

Cuts are quantiles of the points of a key, so a burst is cut as finely as any other rows; an interval goes into each cut it touches.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import rows_per_bin

# Cuts of a key at most; a cut holds a share of the rows of a time bin, as its rows pass through Python.
MOST_CUTS = 64
CUT_SHARE = 16


def enclosing_least(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, at: str, start: str, end: str,
                    rank: Sequence[str], carry: Sequence[str] = (), lanes: Sequence[str] = (), k: int = 1, until: str | None = None) -> DataFrame:
    """For each point the ``k`` least intervals by ``rank`` with ``start <= at < end``, apart for each value of ``lanes``.

    Rows: keys, ``point``, ``at`` and ``lanes``, an array of structs of the lane columns, ``n`` (intervals of the lane around the point)
    and ``least`` (structs of rank and carry columns in order). ``until`` names a time of the point that an interval must reach, too;
    ``n`` does not look at it. Points in no interval are left out. ``point`` identifies a point within its keys; it and times are BIGINT.
    """
    solid = intervals.filter(F.col(end) > F.col(start))
    asked = points.filter(F.col(at).isNotNull())
    if until is not None:
        asked = asked.filter(F.col(until).isNotNull())
    cuts = _cuts(asked, keys, at)
    span, found = [*lanes, *rank, *carry], [*rank, *carry]
    empty = [F.lit(None).cast(intervals.schema[c].dataType).alias(f"_v{i}") for i, c in enumerate(span)]
    dealt = asked.join(cuts, list(keys)).select(
        *keys, F.expr(f"size(filter(_cuts, x -> x <= {at}))").alias("_cut"), F.col(at).alias("_t"), F.lit(1).alias("_side"),
        F.col(point).alias("_id"), (F.col(until) if until else F.lit(None).cast("bigint")).alias("_to"), *empty)
    spread = solid.join(cuts, list(keys)).select(
        *keys, F.explode(F.expr(f"sequence(size(filter(_cuts, x -> x <= {start})), size(filter(_cuts, x -> x < {end})))")).alias("_cut"),
        F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_id"), F.col(end).alias("_to"),
        *[F.col(c).alias(f"_v{i}") for i, c in enumerate(span)])
    place = [*keys, "_cut"]
    ordered = dealt.unionByName(spread).repartition(*place).sortWithinPartitions(*place, "_t", "_side")
    least = StructType([StructField(c, intervals.schema[c].dataType) for c in found])
    lane = StructType([*[StructField(c, intervals.schema[c].dataType) for c in lanes], StructField("n", LongType()), StructField("least", ArrayType(least))])
    schema = StructType([*[points.schema[c] for c in keys], StructField(point, LongType()), StructField(at, LongType()), StructField("lanes", ArrayType(lane))])
    widths, names = (len(place), len(lanes), len(rank)), (list(lanes), found)
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _swept(batches, widths, names, k, until is not None):
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), kind)], schema=kind)

    return ordered.mapInArrow(run, schema)


def _cuts(points: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Instants that cut the time axis of each key into parts of like many points."""
    rows = max(1, rows_per_bin(points.sparkSession) // CUT_SHARE)
    shares = ", ".join(f"{i / MOST_CUTS}D" for i in range(1, MOST_CUTS))
    per_key = points.groupBy(*keys).agg(F.expr(f"percentile_approx({at}, array({shares}), 1000)").alias("_q"), F.count(F.lit(1)).alias("_n"))
    step = f"greatest(CAST({MOST_CUTS} DIV least({MOST_CUTS}, 1 + _n DIV {rows}) AS INT), 1)"
    return per_key.selectExpr(*keys, f"IF(_n <= {rows}, CAST(array() AS array<bigint>), array_distinct(filter(_q, (x, i) -> (i + 1) % {step} = 0))) AS _cuts")


def _nulls_first(value):
    return [(x is not None, x) for x in value] if isinstance(value, list) else value


def _swept(batches: Iterator[pa.RecordBatch], widths: tuple[int, int, int], names: tuple[list[str], list[str]], k: int, reach: bool) -> Iterator[list[tuple]]:
    """Result rows of batches in the order of place, time and side; the open intervals of a place are kept by lane."""
    (n_place, n_lane, n_rank), (lane_names, found) = widths, names
    here, lanes, number = None, {}, 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        places, values, out = list(zip(*columns[:n_place])), list(zip(*columns[n_place + 4:])), []
        for place, t, side, ident, to, value in zip(places, *columns[n_place:n_place + 4], values):
            if place != here:
                here, lanes = place, {}
            if side == 0:
                number += 1
                key = value[:n_lane]
                if key not in lanes:
                    lanes[key] = ([], [])
                heap, ends = lanes[key]
                heappush(heap, ([_nulls_first(v) for v in value[n_lane:n_lane + n_rank]], number, to, value[n_lane:]))
                heappush(ends, to)
                continue
            around = []
            for key in list(lanes):
                heap, ends = lanes[key]
                while ends and ends[0] <= t:
                    heappop(ends)
                if not ends:
                    del lanes[key]
                    continue
                least = _least(heap, t, to if reach else t, k)
                if least:
                    around.append(dict(zip(lane_names, key)) | {"n": len(ends), "least": [dict(zip(found, v)) for v in least]})
            if around:
                out.append((*place[:-1], ident, t, around))
        if out:
            yield out


def _least(heap: list, t: int, to: int, k: int) -> list[tuple]:
    """Values of the ``k`` least entries that are open at ``t`` and reach ``to``; closed ones on the way leave the heap."""
    if k == 1:
        while heap and heap[0][2] <= t:
            heappop(heap)
        if heap and heap[0][2] >= to:
            return [heap[0][3]]
    kept, values = [], []
    while heap and len(values) < k:
        entry = heappop(heap)
        if entry[2] > t:
            kept.append(entry)
            if entry[2] >= to:
                values.append(entry[3])
    for entry in kept:
        heappush(heap, entry)
    return values
