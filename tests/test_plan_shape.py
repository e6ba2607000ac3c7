"""Physical plans must not hold operators that fail on large data."""

import pytest

from gatelake import catalog
from gatelake.catalog.registry import JOBS

SF = "/root/testdata/sf0.001"
catalog.load()
BATCH = sorted(n for n in JOBS if not n.startswith("stream_"))
# Pairs of rows, one task for all rows, or a driver-side collect.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "CollectLimit", "BatchEvalPython")


@pytest.mark.parametrize("name", BATCH)
def test_plan(spark, name):
    plan = JOBS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [f for f in FORBIDDEN if f in plan] == []
    # Only relations of this code with a fixed number of rows may be hinted.
    assert "strategy=broadcast" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = JOBS["gate_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.splitlines() if "FileScan" in line]
    assert "l_extendedprice" not in scan and "l_shipdate" in scan
    plan = JOBS["deploy_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,signup)" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("newest_commits", "changelog", "unrecorded_prs", "dependency_updates"):
        plan = JOBS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, name
