"""The backtests evaluate every fixture from the split date on."""

import os

import pytest

from oddsmill.operators import backtest
from oddsmill.plans import catalog, rebuild

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_evaluation_begins_at_the_split_date(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    rows = [(r.fixture_id, r.match_date) for r in rebuild.expectations(spark, SF).select("fixture_id", "match_date").collect()]
    dates = sorted({d for _, d in rows})
    start = dates[len(dates) * 3 // 4]
    asked = catalog._evaluated(spark, SF).select("fixture_id", "as_of").collect()
    assert sorted(r.fixture_id for r in asked) == sorted(f for f, d in rows if d >= start)
    assert min(r.as_of for r in asked) == start


def test_weights_are_summed_over_all_of_them(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    asked = catalog._evaluated(spark, SF).count()
    got = catalog.QUERIES["k7_weight_summary"](spark, SF).collect()
    assert sorted(r.weight for r in got) == sorted(backtest.WEIGHTS) and {r.fixtures for r in got} == {asked}
