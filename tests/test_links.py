import build
import pytest
from stepscope.operators import events, links, steps

DEC = "execute_context_0(0)_generation_1(1)"


def parts(spark, rows, edges=()):
    s = build.slices(spark, *rows)
    return s, events.window_events(s), events.runtimes(s), build.flows(spark, *edges)


def base_rows():
    return [build.row(1, DEC, "user_annotation", 0, 100), build.row(2, DEC, "user_annotation", 200, 100),
            build.row(10, "launch", "cuda_runtime", 10, 5, correlation="7"), build.row(11, "launch", "cuda_runtime", 210, 5, correlation="8")]


def test_fan_out_basis_and_ownership(spark):
    rows = base_rows() + [build.row(20, "SET", "kernel", 40, 0, correlation="7", device="0"),
                          build.row(21, "k", "kernel", 50, 20, correlation="7", device="0"),
                          build.row(22, "k", "kernel", 100, 20, correlation="8", device="0")]
    s, device, runtimes, flows = parts(spark, rows, [(10, 20)])
    profile = links.event_links(device, runtimes, flows)
    assert {r.id: r.basis for r in profile.collect()} == {20: "flow+correlation", 21: "correlation", 22: "correlation"}
    scopes = s.filter("category = 'user_annotation'")
    owned = links.owned_events(profile, links.scope_runtimes(scopes, runtimes), runtimes, flows)
    assert sorted((r.scope_id, r.id) for r in owned.collect()) == [(1, 20), (1, 21), (2, 22)]


def test_step_window(spark):
    rows = base_rows() + [build.row(20, "SET", "kernel", 40, 0, correlation="7", device="0"),
                          build.row(21, "k", "kernel", 50, 100, correlation="7", device="0"),
                          build.row(23, "k", "kernel", 60, 5, device="0"), build.row(22, "k", "kernel", 220, 20, correlation="8", device="0"),
                          build.row(24, "k", "kernel", 90, 200, correlation="7", device="0")]
    s, device, runtimes, flows = parts(spark, rows)
    got = {r.step: r for r in steps.step_windows(steps.step_pairs(s, "decode"), device, runtimes, flows).collect()}
    first = got[1]
    assert (first.start_ns, first.end_ns, first.period_us, first.error_code) == (40, 220, .18, None)
    assert (first.owned_in_window, first.not_owned_in_window, first.owned_crossing_end) == (3, 1, 1)
    assert got[2].error_code == "no_next_annotation"


@pytest.mark.parametrize("extra, code", [
    ([build.row(20, "k", "kernel", 40, 1, device="0")], "no_owned_event"),
    ([build.row(20, "k", "kernel", 40, 1, correlation="7", device="0"), build.row(21, "k", "kernel", 45, 1, correlation="7", device="1")], "multiple_devices"),
    ([build.row(20, "k", "kernel", 5, 1, correlation="7", device="0")], "unfinished_or_before_launch"),
])
def test_boundary_errors(spark, extra, code):
    s, device, runtimes, flows = parts(spark, base_rows() + extra)
    got = {r.scope_id: r.error_code for r in links.scope_boundaries(s.filter("category = 'user_annotation'"), device, runtimes, flows).collect()}
    assert got[1] == code


def test_conflicting_event_before_the_first_owned_one(spark):
    rows = base_rows() + [build.row(20, "k", "kernel", 40, 1, correlation="7", device="0"), build.row(21, "k", "kernel", 30, 1, correlation="7", device="0")]
    s, device, runtimes, flows = parts(spark, rows, [(11, 21)])
    got = {r.scope_id: r for r in links.scope_boundaries(s.filter("id = 1"), device, runtimes, flows).collect()}
    assert (got[1].error_code, got[1].ambiguous_event_count) == ("ambiguous_earlier_event", 1)


def test_step_numbers(spark):
    rows = [build.row(i, DEC, "user_annotation", i * 100, 50) for i in range(1, 5)]
    pairs = steps.step_pairs(build.slices(spark, *rows))
    assert [(r.step, r.error_code) for r in pairs.orderBy("step").collect()] == [(1, None), (2, None), (3, None), (4, "no_next_annotation")]
    with pytest.raises(ValueError):
        steps.nth_step(pairs, 0)
    several = build.slices(spark, *rows, build.row(9, DEC, "user_annotation", 900, 10, tid="2"))
    assert {r.error_code for r in steps.step_pairs(several).collect()} == {"multiple_host_tracks"}
