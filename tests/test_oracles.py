"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import check
from gatelake import catalog
from gatelake.catalog.registry import JOBS, ORACLES

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    problem = check.compare(spark, con, SF, JOBS[name], ORACLES[name])
    # A thousandth of the data leaves a few results empty on both sides.
    assert problem in (None, "no rows")


@pytest.mark.parametrize("name", sorted(set(JOBS) - set(ORACLES)))
def test_runs(spark, name):
    assert JOBS[name](spark, SF).count() > 0
