"""Launch links of device events, and which host scopes own them.

A device event's possible launches are all runtime calls with its correlation id plus the sources of
its flow edges. Reused ids make those sets large, and every event of one id has the same set, so sets
stay implicit: calls are summarised once per (trace, correlation), flow edges per event, and set tests
become comparisons of counts. Nothing is gathered into arrays and no event meets every call of its id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import enclosure_join
from ..functions.sweep import enclosing_least
from ..session import materialize

BASIS = ("CASE WHEN n_corr > 0 AND n_flow > 0 THEN IF(n_both > 0, 'flow+correlation', 'conflicting-flow-correlation') "
         "WHEN n_corr > 0 THEN 'correlation' WHEN n_flow > 0 THEN 'flow' ELSE 'unlinked' END")
# How a measure over two overlapping call sets is combined.
_UNION = {
    "min": "least(g_{m}, f_{m})", "max": "greatest(g_{m}, f_{m})",
    "bit_and": "coalesce(g_{m} & f_{m}, g_{m}, f_{m})", "bit_or": "coalesce(g_{m} | f_{m}, g_{m}, f_{m})",
    "sum": "coalesce(g_{m}, 0) + coalesce(f_{m}, 0) - coalesce(b_{m}, 0)",
}
_EVENT = ["id", "name", "category", "ts_ns", "dur_ns", "track_id", "device", "stream", "correlation", "basis",
          "cand_launch_ts"]


def link_profile(device: DataFrame, runtimes: DataFrame, flows: DataFrame,
                 measures: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Device events with link ``basis``, set sizes and measures over their launches.

    A measure is ``name: (aggregate, runtime expression)`` with aggregate min, max, sum, bit_and or
    bit_or. It appears as ``cand_name`` over the candidate launches and ``poss_name`` over all possible
    ones. Candidates are the agreeing launches where both kinds of link exist, else whichever kind does.
    """
    measures = measures or {}
    calls = runtimes.selectExpr("trace_id", "id AS _rid", "correlation AS _rcorr",
                                *[f"{expr} AS {m}" for m, (_, expr) in measures.items()])
    groups = calls.filter("_rcorr IS NOT NULL").groupBy("trace_id", F.col("_rcorr").alias("correlation")).agg(
        F.expr("count(1) AS n_corr"), *[F.expr(f"{op}({m}) AS g_{m}") for m, (op, _) in measures.items()])
    edges = (flows.selectExpr("trace_id", "slice_out AS _rid", "slice_in AS id")
             .join(calls, ["trace_id", "_rid"])
             .join(device.selectExpr("trace_id", "id", "correlation AS _ecorr"), ["trace_id", "id"])
             .dropDuplicates(["trace_id", "id", "_rid"]))
    per_event = edges.groupBy("trace_id", "id").agg(
        F.expr("count(1) AS n_flow"), F.expr("count_if(_rcorr = _ecorr) AS n_both"),
        *[F.expr(f"{op}({m}) AS f_{m}") for m, (op, _) in measures.items()],
        *[F.expr(f"{op}(CASE WHEN _rcorr = _ecorr THEN {m} END) AS b_{m}") for m, (op, _) in measures.items()])
    joined = device.join(groups, ["trace_id", "correlation"], "left").join(per_event, ["trace_id", "id"], "left")
    counted = joined.selectExpr(
        *[c for c in joined.columns if c not in ("n_corr", "n_flow", "n_both")],
        *[f"coalesce({c}, 0L) AS {c}" for c in ("n_corr", "n_flow", "n_both")]).selectExpr("*", f"{BASIS} AS basis")
    pick = "CASE basis WHEN 'correlation' THEN g_{m} WHEN 'flow' THEN f_{m} WHEN 'flow+correlation' THEN b_{m} END"
    return counted.selectExpr(
        *device.columns, "basis",
        "CASE basis WHEN 'correlation' THEN n_corr WHEN 'flow' THEN n_flow WHEN 'flow+correlation' THEN n_both "
        "ELSE 0L END AS candidate_count", "n_corr + n_flow - n_both AS possible_count",
        *[f"{pick.format(m=m)} AS cand_{m}" for m in measures],
        *[f"{_UNION[op].format(m=m)} AS poss_{m}" for m, (op, _) in measures.items()])


def event_links(device: DataFrame, runtimes: DataFrame, flows: DataFrame) -> DataFrame:
    """Link profile with the latest candidate launch time, as the ownership operators need it."""
    return link_profile(device, runtimes, flows, {"launch_ts": ("max", "ts_ns")})


def scope_runtimes(scopes: DataFrame, runtimes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Runtime calls each host scope encloses: same thread, start inside, end not past the scope's.

    ``carry`` names scope columns to keep.
    """
    calls = runtimes.filter("host_thread IS NOT NULL").selectExpr(
        "trace_id", "host_thread", "id AS runtime_id", "ts_ns AS rt_ts", "ts_ns + dur_ns AS rt_end",
        "correlation AS rt_correlation", "track_id AS rt_track")
    spans = scopes.filter("host_thread IS NOT NULL").selectExpr(
        "trace_id", "host_thread", "id AS scope_id", "ts_ns AS scope_start", "ts_ns + dur_ns AS scope_end",
        "track_id AS scope_track", *carry)
    inside = enclosure_join(calls, spans, ["trace_id", "host_thread"], "rt_ts", "scope_start", "scope_end")
    return inside.filter("rt_end <= scope_end").selectExpr(
        "trace_id", "scope_id", "runtime_id", "rt_ts", "rt_correlation", "rt_track = scope_track AS on_track", *carry)


def least_scopes(scopes: DataFrame, runtimes: DataFrame, rank: list[str], carry: tuple[str, ...] = (), lanes: tuple[str, ...] = ()) -> DataFrame:
    """Least scope by ``rank`` of those that enclose each runtime call, see :func:`scope_runtimes`, apart for each value of ``lanes``.

    No scope meets a call that does not take it, see :func:`enclosing_least`.
    """
    calls = runtimes.filter("host_thread IS NOT NULL").selectExpr("trace_id", "host_thread", "id AS runtime_id", "ts_ns AS rt_ts", "ts_ns + dur_ns AS rt_end")
    spans = scopes.filter("host_thread IS NOT NULL").selectExpr("*", "ts_ns AS scope_start", "ts_ns + dur_ns AS scope_end")
    return enclosing_least(calls, spans, ["trace_id", "host_thread"], "runtime_id", "rt_ts", "scope_start", "scope_end", rank, carry, lanes, until="rt_end")


def _group_touch(scope_rt: DataFrame) -> DataFrame:
    """Calls of each correlation id inside each scope."""
    return scope_rt.filter("rt_correlation IS NOT NULL").groupBy(
        "trace_id", F.col("rt_correlation").alias("correlation"), "scope_id").agg(
        F.expr("count(1) AS n_in"), F.expr("bool_or(on_track) AS on_track"))


def owned_events(links: DataFrame, scope_rt: DataFrame, runtimes: DataFrame, flows: DataFrame) -> DataFrame:
    """(scope, event) pairs where every candidate launch of the event lies in the scope."""
    sizes = runtimes.filter("correlation IS NOT NULL").groupBy("trace_id", "correlation").agg(F.expr("count(1) AS n_corr"))
    whole_groups = _group_touch(scope_rt).join(sizes, ["trace_id", "correlation"]).filter("n_in = n_corr").select(
        "trace_id", "correlation", "scope_id", "on_track")
    by_group = links.filter("basis = 'correlation'").join(whole_groups, ["trace_id", "correlation"]).select(
        "trace_id", "scope_id", *_EVENT, "on_track")
    explicit = links.filter("basis IN ('flow', 'flow+correlation')").select("trace_id", *_EVENT, "candidate_count")
    edges = (flows.selectExpr("trace_id", "slice_out AS runtime_id", "slice_in AS id")
             .join(scope_rt.select("trace_id", "runtime_id", "scope_id", "rt_correlation", "on_track"),
                   ["trace_id", "runtime_id"])
             .join(explicit, ["trace_id", "id"]).filter("basis = 'flow' OR rt_correlation = correlation")
             .dropDuplicates(["trace_id", "id", "scope_id", "runtime_id"]))
    by_flow = edges.groupBy("trace_id", "id", "scope_id").agg(
        F.expr("count(1) AS n_in"), F.expr("any_value(candidate_count) AS n_all"), F.expr("bool_or(on_track) AS on_track"),
        F.expr(f"any_value(struct({', '.join(c for c in _EVENT if c != 'id')})) AS e")).filter("n_in = n_all").select(
        "trace_id", "scope_id", "id", "e.*", "on_track")
    return by_group.unionByName(by_flow)


def uncertain_events(links: DataFrame, owned: DataFrame, scope_rt: DataFrame, flows: DataFrame) -> DataFrame:
    """Per scope: events with a possible launch inside that the scope does not own, and their earliest start.

    Events reached through their correlation id are counted per id; only events reached through a flow
    edge alone are looked at one by one. ``touched_min_ts`` covers owned events too.
    """
    touch = _group_touch(scope_rt)
    linked = links.filter("basis IN ('correlation', 'flow+correlation', 'conflicting-flow-correlation')")
    by_id = linked.groupBy("trace_id", "correlation").agg(F.expr("count(1) AS n_events"), F.expr("min(ts_ns) AS id_min_ts"))
    touched = touch.join(by_id, ["trace_id", "correlation"]).groupBy("trace_id", "scope_id").agg(
        F.expr("sum(n_events) AS n"), F.expr("min(id_min_ts) AS min_ts"))
    pairs = (flows.selectExpr("trace_id", "slice_out AS runtime_id", "slice_in AS id")
             .join(scope_rt.select("trace_id", "runtime_id", "scope_id"), ["trace_id", "runtime_id"])
             .select("trace_id", "id", "scope_id").distinct()
             .join(links.select("trace_id", "id", "correlation", "ts_ns", "basis"), ["trace_id", "id"]))
    flow_only = pairs.filter("basis = 'flow'").join(owned, ["trace_id", "id", "scope_id"], "left_anti")
    stray = pairs.filter("basis <> 'flow'").join(touch, ["trace_id", "correlation", "scope_id"], "left_anti")
    # Scopes that flow edges touch stay in the result without an uncertain event, too.
    reached = pairs.selectExpr("trace_id", "scope_id", "CAST(NULL AS BIGINT) AS ts_ns")
    extra = flow_only.select(*reached.columns).unionByName(stray.select(*reached.columns)).unionByName(reached) \
        .groupBy("trace_id", "scope_id").agg(F.expr("count(ts_ns) AS n_extra"), F.expr("min(ts_ns) AS extra_ts"))
    mine = owned.filter("basis <> 'flow'").groupBy("trace_id", "scope_id").agg(F.expr("count(1) AS n_mine"))
    joined = touched.join(extra, ["trace_id", "scope_id"], "full").join(mine, ["trace_id", "scope_id"], "left")
    return joined.selectExpr(
        "trace_id", "scope_id",
        "coalesce(n, 0) - coalesce(n_mine, 0) + coalesce(n_extra, 0) AS uncertain_count",
        "min_ts AS touched_min_ts", "extra_ts AS extra_min_ts")


def tied_uncertain(links: DataFrame, scope_rt: DataFrame, first_ts: DataFrame) -> DataFrame:
    """Events reached through their correlation id that start exactly at a scope's first device time."""
    linked = links.filter("basis IN ('correlation', 'flow+correlation', 'conflicting-flow-correlation')")
    return (_group_touch(scope_rt).join(first_ts.select("trace_id", "scope_id", "ts_ns"), ["trace_id", "scope_id"])
            .join(linked.select("trace_id", "correlation", "ts_ns"), ["trace_id", "correlation", "ts_ns"])
            .groupBy("trace_id", "scope_id").agg(F.expr("count(1) AS n_tied_touched")))


def scope_boundaries(scopes: DataFrame, device: DataFrame, runtimes: DataFrame, flows: DataFrame,
                     explicit_scope: bool = False) -> DataFrame:
    """First owned device event of each scope with its evidence; ``error_code`` where none can be trusted."""
    links = materialize(event_links(device, runtimes, flows))
    scope_rt = materialize(scope_runtimes(scopes, runtimes))
    owned = materialize(owned_events(links, scope_rt, runtimes, flows))
    return boundaries_from(scopes, links, scope_rt, owned, flows, explicit_scope)


def boundaries_from(scopes: DataFrame, links: DataFrame, scope_rt: DataFrame, owned: DataFrame, flows: DataFrame,
                    explicit_scope: bool = False) -> DataFrame:
    """``scope_boundaries`` on links, scope calls and owned events that are already stored."""
    starts = owned.groupBy("trace_id", "scope_id", "ts_ns").agg(
        F.expr("count(1) AS n"), F.expr("count_if(basis <> 'flow') AS n_by_id"),
        F.expr("min_by(struct(id, name, category, track_id, device, stream, correlation, dur_ns, basis, on_track), id) AS e"),
        F.expr("bool_or(dur_ns < 0 OR cand_launch_ts > ts_ns) AS bad"), F.expr("min(device) AS d1"),
        F.expr("max(device) AS d2"), F.expr("count_if(device IS NULL) AS d0"), F.expr("min(track_id) AS t1"),
        F.expr("max(track_id) AS t2"))
    first = starts.groupBy("trace_id", "scope_id").agg(
        F.expr("min(ts_ns) AS ts_ns"), F.expr("min_by(struct(n, n_by_id, e, bad), ts_ns) AS f"), F.expr("sum(n) AS owned_count"),
        F.expr("min(d1) AS d1"), F.expr("max(d2) AS d2"), F.expr("sum(d0) AS d0"), F.expr("min(t1) AS t1"), F.expr("max(t2) AS t2"))
    spans = scopes.selectExpr("trace_id", "id AS scope_id", "name AS annotation", "ts_ns AS scope_start",
                              "ts_ns + dur_ns AS scope_end")
    near = enclosure_join(
        links.filter("basis = 'unlinked'").selectExpr("trace_id", "ts_ns AS at"),
        first.join(spans, ["trace_id", "scope_id"]).selectExpr("trace_id", "scope_id", "scope_start AS a", "ts_ns + 1 AS b"),
        ["trace_id"], "at", "a", "b").groupBy("trace_id", "scope_id").agg(F.expr("count(1) AS near_unlinked"))
    keys = ["trace_id", "scope_id"]
    joined = (spans.join(first, keys, "left").join(uncertain_events(links, owned, scope_rt, flows), keys, "left")
              .join(tied_uncertain(links, scope_rt, first), keys, "left").join(near, keys, "left"))
    ambiguous = ("least(touched_min_ts, ts_ns) < ts_ns OR extra_min_ts <= ts_ns "
                 "OR coalesce(n_tied_touched, 0) > f.n_by_id")
    unknown_device = "FALSE" if explicit_scope else "d0 = owned_count AND t1 <> t2"
    return joined.selectExpr(
        *keys, "annotation", "scope_start", "scope_end", "f.e.id AS first_event_id", "f.e.name AS first_event_name",
        "ts_ns AS first_ts_ns", "f.e.device AS device", "f.e.stream AS stream", "f.e.correlation AS correlation",
        "concat(IF(f.e.on_track, 'descendant-runtime+', 'same-host-thread-enclosure+'), f.e.basis) AS association_basis",
        "coalesce(f.n, 0L) AS tied_first_events", "coalesce(owned_count, 0L) AS owned_event_count",
        "coalesce(uncertain_count, 0L) AS ambiguous_event_count", "coalesce(near_unlinked, 0L) AS unlinked_near_boundary",
        "IF(f IS NULL, NULL, IF(near_unlinked > 0, 'first-confirmed-link; nearby-unlinked-events', "
        "'confirmed-within-recorded-links')) AS boundary_confidence",
        "CASE WHEN owned_count IS NULL THEN 'no_owned_event' "
        "WHEN d1 <> d2 OR (d0 > 0 AND d1 IS NOT NULL) THEN 'multiple_devices' "
        f"WHEN {unknown_device} THEN 'unknown_device_on_several_tracks' "
        f"WHEN {ambiguous} THEN 'ambiguous_earlier_event' "
        "WHEN f.bad THEN 'unfinished_or_before_launch' END AS error_code")
