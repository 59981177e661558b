import random

from pyspark.sql import functions as F

from stepscope.functions.layout import enclosure_join, latest_before, ordered_index, ordered_ranges, union_length


def test_enclosure_equals_brute_force(spark, small_bins):
    rng = random.Random(5)
    spans = [(i, rng.randrange(10_000), rng.choice([1, 3, 50, 700, 9000])) for i in range(120)]
    points = [(i, t) for i, t in enumerate([0, 15, 999, 1000, 9999, 10000] + [rng.randrange(12_000) for _ in range(80)])]
    got = enclosure_join(
        spark.createDataFrame([("t", *p) for p in points], "trace_id STRING, pid BIGINT, at BIGINT"),
        spark.createDataFrame([("t", i, s, s + d) for i, s, d in spans], "trace_id STRING, sid BIGINT, start BIGINT, end BIGINT"),
        ["trace_id"], "at", "start", "end").select("pid", "sid").collect()
    want = {(p, i) for p, t in points for i, s, d in spans if s <= t < s + d}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_as_of_equals_brute_force(spark, small_bins):
    rng = random.Random(6)
    right = [(i, rng.randrange(300)) for i in range(60)]
    left = [(i, rng.randrange(320)) for i in range(60)]
    schema = "trace_id STRING, id BIGINT, at BIGINT"
    got = latest_before(spark.createDataFrame([("t", *r) for r in left], schema), spark.createDataFrame([("t", *r) for r in right], schema),
                        ["trace_id"], "at", F.col("id"), -F.col("id"), "found").collect()
    for r in got:
        best = max(((t, -i) for i, t in right if t <= r["at"]), default=None)
        assert r.found == (None if best is None else -best[1])


def test_order_equals_brute_force(spark, small_bins):
    rng = random.Random(7)
    rows = [("t", i, rng.randrange(50)) for i in range(40)]
    got = ordered_index(spark.createDataFrame(rows, "trace_id STRING, id BIGINT, at BIGINT"), ["trace_id"], "at", ["id"], ["id"]).collect()
    order = [i for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1]))]
    for r in got:
        at = order.index(r.id)
        assert (r.idx, r.idx_count) == (at, 40)
        assert (r.next_row.id if r.next_row else None) == (order[at + 1] if at < 39 else None)
        assert (r.prev_row.id if r.prev_row else None) == (order[at - 1] if at else None)


def test_union_equals_brute_force(spark, small_bins):
    rng = random.Random(8)
    spans = [("t", s, s + rng.choice([0, 1, 5, 40]), rng.random() < .5) for s in (rng.randrange(300) for _ in range(60))]
    got = union_length(spark.createDataFrame(spans, "trace_id STRING, s BIGINT, e BIGINT, f BOOLEAN"), ["trace_id"], "s", "e", "f").collect()[0]
    assert got.union_all == len({x for _, s, e, _ in spans for x in range(s, e)})
    assert got.union_flagged == len({x for _, s, e, f in spans if f for x in range(s, e)})


def bursts():
    """A key with nearly all rows in a hundredth of its span, and one with all rows at one instant."""
    rng = random.Random(9)
    rows = [("burst", i, 500_000 + rng.randrange(10_000) if i % 100 else rng.randrange(1_000_000)) for i in range(2600)]
    return rows + [("instant", i, 7) for i in range(2600)]


def test_ranges_part_bursts_and_instants(spark, small_bins):
    """No key has more than twice the rows of an even share in one range."""
    frame = spark.createDataFrame(bursts(), "trace_id STRING, id BIGINT, at BIGINT")
    held = ordered_ranges(frame, ["trace_id"], ["at", "id"]).groupBy("trace_id", "_bin").count().collect()
    assert max(r["count"] for r in held) <= 2 * 5200 / 13 and len({r._bin for r in held}) == 13


def test_bursts_do_not_change_results(spark, small_bins):
    rows = bursts()
    frame = spark.createDataFrame(rows, "trace_id STRING, id BIGINT, at BIGINT")
    got = {(r.trace_id, r.id): (r.idx, r.next_row.id if r.next_row else None) for r in ordered_index(frame, ["trace_id"], "at", ["id"], ["id"]).collect()}
    for key in ("burst", "instant"):
        order = [i for k, i, _ in sorted(rows, key=lambda r: (r[2], r[1])) if k == key]
        assert all(got[key, i] == (n, order[n + 1] if n + 1 < len(order) else None) for n, i in enumerate(order))
    spans = frame.selectExpr("trace_id", "at AS s", "at + 1 + id % 50 AS e", "id % 3 = 0 AS f")
    for r in union_length(spans, ["trace_id"], "s", "e", "f").collect():
        own = [(at, at + 1 + i % 50, i % 3 == 0) for k, i, at in rows if k == r.trace_id]
        assert r.union_all == len({x for a, b, _ in own for x in range(a, b)})
        assert r.union_flagged == len({x for a, b, f in own if f for x in range(a, b)})
    launches = frame.filter("id % 7 = 0")
    found = {(r.trace_id, r.id): r.latest for r in latest_before(frame, launches, ["trace_id"], "at", F.col("id"), F.col("id")).collect()}
    for key in ("burst", "instant"):
        own = sorted((at, i) for k, i, at in rows if k == key)
        calls = [(at, i) for at, i in own if i % 7 == 0]
        for at, i in own[::37]:
            before = [c for c in calls if c[0] <= at]
            assert found[key, i] == (before[-1][1] if before else None)
