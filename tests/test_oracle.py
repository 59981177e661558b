"""Every registered query against its DuckDB statement."""
import oracle_compare
import pytest

from stepscope.plans.catalog import QUERIES
from stepscope.plans.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, name):
    assert name in SQL
    assert oracle_compare.difference(QUERIES[name](spark, SF), oracle_compare.connect(SF), SQL[name]) is None


@pytest.mark.parametrize("name", [
    "window_coverage", "time_account", "bubble_variants", "step_windows", "step_boundary", "nth_step", "step_gaps", "attribution_tiers", "asof_launch",
    "innermost_op", "frame_stack", "phase_split", "launch_counts", "scope_runtimes", "carry_in", "card_state", "expert_launches", "link_reconcile"])
def test_bins_do_not_change_results(spark, small_bins, name):
    assert oracle_compare.difference(QUERIES[name](spark, SF), oracle_compare.connect(SF), SQL[name]) is None
