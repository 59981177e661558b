"""Distributed forms of ordered scans, as-of lookups, enclosure joins and interval unions.

A plain window over one trace, or an enclosure join keyed by one host thread, puts the whole of a hot trace into one task.

Ordered scans, as-of lookups and unions deal rows by ranges of (keys, time, ties, row): Spark samples the edges, so ranges hold like
numbers of rows whatever the bursts of a trace, and rows of one instant are parted by their order. They work inside the ranges and
stitch them together from one summary row per key and range. Ranges are stored before they are read twice, so both readers see the
same edges. Results do not depend on them.

Enclosure joins cut the time axis into bins whose width follows the length of intervals, limited by the density of a trace.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, rows_per_bin

# One bin for everything: start of the only bin is 0 for any nonnegative time below this width.
WHOLE_AXIS = 1 << 62
# Widths are kept by a hash of the key with so many values.
WIDTH_SLOTS = 1024
# Interval width classes are powers of 2**CLASS_STEP.
CLASS_STEP = 3
MIN_CLASS_BITS = 9


def bin_start(at: Column, width: Column) -> Column:
    """First instant of the bin that holds a time."""
    return at - F.pmod(at, width)


def bin_width(df: DataFrame, at: str, keys: Sequence[str] = ("trace_id",), target: int | None = None) -> Column:
    """Bin width of a row's key, at which a hot key holds about ``target`` rows a bin.

    The statistics are one partially aggregated row per key. They are folded into a scalar subquery of
    ``WIDTH_SLOTS`` widths, found by a hash of the key, so a dense key does not cut the others finer.
    Keys below the target have one bin, and so have keys whose rows share one instant: cuts cannot part them.
    """
    rows = target or rows_per_bin(df.sparkSession)
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    hot = per_key.filter((F.col("n") > rows) & (F.col("hi") > F.col("lo"))).select(
        _slot(keys).alias("slot"), (((F.col("hi") - F.col("lo") + 1) / F.col("n")) * F.lit(float(rows))).cast("bigint").alias("w"))
    slots = hot.groupBy("slot").agg(F.min("w").alias("w"))
    widths = slots.agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(WIDTH_SLOTS - 1)), lambda i: F.try_element_at("m", i)).alias("w")).scalar()
    return F.greatest(F.coalesce(F.get(widths, _slot(keys)), F.lit(WHOLE_AXIS)), F.lit(1).cast("bigint"))


def _slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(WIDTH_SLOTS)).cast("int")


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach per-key totals by aggregate and join, so no key is gathered into one window partition."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(sums, list(keys))


def ordered_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows, stored, with ``_bin``: ranges in the order of keys and ``order``; and ``_tie``, which parts rows that are equal in it."""
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    return materialize(dealt.repartitionByRange(*keys, *order, "_tie").withColumn("_bin", F.spark_partition_id()))


def ordered_index(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Number rows of each key by time (``idx`` from 0, ``idx_count`` rows in all) and attach the
    neighbouring rows' ``carry`` columns as structs ``prev_row`` and ``next_row``."""
    binned = ordered_ranges(df, keys, [at, *ties])
    payload = F.struct(*[F.col(c) for c in (carry or (at,))])
    order = F.struct(F.col(at), *[F.col(c) for c in ties], F.col("_tie"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(at, *ties, "_tie")
    local = (binned.withColumn("_rn", F.row_number().over(inside) - 1)
             .withColumn("_prev", F.lag(payload).over(inside))
             .withColumn("_next", F.lead(payload).over(inside)))
    summary = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(payload, order).alias("_first"), F.max_by(payload, order).alias("_last"))
    bins = Window.partitionBy(*keys).orderBy("_bin")
    before = bins.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    stitched = summary.select(
        *keys, "_bin",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(everything).alias("idx_count"),
        F.lag("_last").over(bins).alias("_prev_bin"),
        F.lead("_first").over(bins).alias("_next_bin"))
    joined = local.join(stitched, [*keys, "_bin"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("_base") + F.col("_rn")).alias("idx"), "idx_count",
        F.coalesce("_prev", "_prev_bin").alias("prev_row"),
        F.coalesce("_next", "_next_bin").alias("next_row"))


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: Column,
                  prefer: Column, name: str = "latest") -> DataFrame:
    """As-of lookup: for each left row the right ``value`` with the greatest time not after it.

    Right rows at one instant are ranked by ``prefer``; the greatest wins. Left rows without a match
    keep NULL. ``at`` names the time column on both sides.
    """
    probe = left.select(*[F.col(k) for k in keys], F.col(at).alias("_at"),
                        F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    source = right.select(*[F.col(k) for k in keys], F.col(at).alias("_at"),
                          F.struct(F.col(at).alias("at"), prefer.alias("rank"), value.alias("value")).alias("_right"))
    both = (probe.select(*keys, "_at", F.lit(1).alias("_side"), "_left", F.lit(None).cast(source.schema["_right"].dataType).alias("_right"))
            .unionByName(source.select(*keys, "_at", F.lit(0).alias("_side"),
                                       F.lit(None).cast(probe.schema["_left"].dataType).alias("_left"), "_right")))
    order = ["_at", "_side", F.col("_right.rank")]
    both = ordered_ranges(both, keys, order)
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    summary = both.groupBy(*keys, "_bin").agg(
        F.max("_right").alias("_last"), F.max("_side").alias("_probed"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = (summary.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
               .filter("_probed = 1").select(*keys, "_bin", "_carry"))
    joined = local.join(carried, [*keys, "_bin"])
    return joined.select("_left.*", F.coalesce(F.col("_seen"), F.col("_carry"))["value"].alias(name))


def width_class(start: str, end: str, cap: str) -> str:
    """SQL for an interval's bin width: a power of two not below its length, limited to the cap."""
    bits = f"greatest(length(bin(greatest({end} - {start} - 1, 0))), {MIN_CLASS_BITS})"
    steps = f"CAST(ceil({bits} / {CLASS_STEP}D) * {CLASS_STEP} AS INT)"
    return f"least(shiftleft(1L, least({steps}, 62)), {cap})"


def enclosure_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
                   cap: Column | None = None) -> DataFrame:
    """Pairs with ``start <= at < end`` on equal keys; columns of both sides, keys once.

    Intervals go into bins as wide as their length class, so each lies in at most two bins unless the
    cap (the width at which the busiest trace stays within one task per bin) cuts it finer. A point
    looks into its own bin of every class in use; a pair meets in exactly one bin.
    """
    cap = bin_width(points, at, keys[:1]) if cap is None else cap
    sized = (intervals.filter(f"{end} > {start}").select("*", cap.alias("_cap"))
             .selectExpr(*_quoted(intervals), f"{width_class(start, end, '_cap')} AS _w"))
    classes = sized.agg(F.collect_set("_w")).scalar()
    placed = sized.selectExpr("*", f"explode(sequence({start} - pmod({start}, _w), "
                                   f"{end} - 1 - pmod({end} - 1, _w), _w)) AS _bin")
    probes = (points.select("*", F.explode(classes).alias("_w"))
              .selectExpr("*", f"{at} - pmod({at}, _w) AS _bin"))
    joined = probes.join(placed, [*keys, "_w", "_bin"])
    return joined.filter(f"{start} <= {at} AND {at} < {end}").drop("_w", "_bin")


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def union_length(intervals: DataFrame, keys: Sequence[str], start: str, end: str, flag: str) -> DataFrame:
    """Length of the union of intervals per key: all of them (``union_all``) and those with a true flag (``union_flagged``).

    In the order of starts, an interval adds what lies past the greatest end before it; ends of earlier ranges are carried over.
    """
    solid = intervals.filter(F.col(end) > F.col(start)).select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.expr(f"IF({flag}, {end}, NULL)").alias("_fe"))
    binned = ordered_ranges(solid, keys, ["_s", "_e"])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_s", "_e", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = binned.withColumn("_m", F.max("_e").over(inside)).withColumn("_fm", F.max("_fe").over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = (binned.groupBy(*keys, "_bin").agg(F.max("_e").alias("_last"), F.max("_fe").alias("_flast"))
               .select(*keys, "_bin", F.max("_last").over(earlier).alias("_c"), F.max("_flast").over(earlier).alias("_fc")))
    gains = local.join(carried, [*keys, "_bin"]).selectExpr(
        *keys, "greatest(_e - greatest(_s, _m, _c), 0L) AS _all", "IF(_fe IS NULL, 0L, greatest(_fe - greatest(_s, _fm, _fc), 0L)) AS _sel")
    return gains.groupBy(*keys).agg(F.sum("_all").alias("union_all"), F.sum("_sel").alias("union_flagged"))
