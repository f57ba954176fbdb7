"""What queries leave on disk, and how wide the rows are that they shuffle."""

import datetime as dt
import os
import zlib

import pytest

from oddsmill.operators import backtest, form, residuals, strength
from oddsmill.plans import catalog, rebuild
from oddsmill.sources import testdata as td
from oddsmill.sources.storage import discard, shared_dir, written

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def tables(spark):
    """Names of the written tables, without what makes them unique."""
    root = shared_dir(spark).removeprefix("file://")
    return sorted(os.listdir(root)) if os.path.isdir(root) else []


def shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") and f.endswith(".data") for top in tops for _, _, files in os.walk(top) for f in files)


def test_a_written_table_leaves_no_shuffle_files(spark):
    spark._jvm.System.gc()
    before = shuffle_files(spark)
    table = written(spark.range(10_000).repartition(4, "id").groupBy("id").count(), "cleaned")
    assert shuffle_files(spark) <= before and table.count() == 10_000
    discard(table)


def test_passes_take_each_others_place(spark):
    before = tables(spark)
    made = strength.strength(form.team_matches(td.results(spark, SF)), passes=4)
    left = [t for t in tables(spark) if t not in before]
    assert sorted(t.split("-")[0] for t in left) == ["fixtures", "strength", "strength"]
    rows = made.count()
    one = written(made, "done", made)
    assert [t.split("-")[0] for t in tables(spark) if t not in before] == ["done"] and one.count() == rows
    discard(one)


@pytest.mark.parametrize(("name", "own"), [("n1_describe", ["described"]), ("n5_team_points", []), ("m4_curve_grid", []), ("l11_cap_grid", []), ("k10_bootstrap", ["evaluated"])])
def test_studies_keep_three_tables(spark, monkeypatch, name, own):
    monkeypatch.setattr(strength, "TOLERANCE", 2e-4 + zlib.crc32(name.encode()) * 1e-15)  # so that nothing is known yet
    before = tables(spark)
    assert catalog.QUERIES[name](spark, SF).count() > 0
    assert sorted(t.split("-")[0] for t in tables(spark) if t not in before) == sorted(["expectations", "played", "strength", *own])


def test_expectations_keep_their_columns(spark):
    rows = rebuild.expectations(spark, SF)
    assert {"fixture_id", "season", "match_date", "home_team_id", "home_score", "away_team_id", "away_score", "expected_home", "expected_total", "home_attack", "league_average"} <= set(rows.columns)


def exchanged(df):
    """Names of the columns of every shuffle in the plan, one list each."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "Exchange":
            out = node.output()
            found.append([out.apply(k).name() for k in range(out.size())])
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    return found


@pytest.fixture
def large(spark):
    """Plans as for tables too large to be broadcast unasked."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k in own:
        spark.conf.unset(k)


def evaluated(spark):
    history = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(k), k % 7, k % 5) for k in range(200)], "match_date date, home_score int, away_score int")
    asked = [(f"f{k}", dt.date(2020, 6, 1) + dt.timedelta(k % 9), k % 6, k % 4, 4.5, 0.5, 3.0, 2.0) for k in range(40)]
    return history, spark.createDataFrame(asked, "fixture_id string, as_of date, ah int, aa int, total_line double, margin_line double, expected_home double, expected_away double")


def test_arrays_of_a_date_are_not_shuffled_with_the_fixtures(large):
    shuffles = exchanged(backtest.history_events(*evaluated(large), "hist"))
    assert any("fixture_id" in c for c in shuffles) and not any("fixture_id" in c and "_total" in c for c in shuffles)


def both_models(spark):
    history, asked = evaluated(spark)
    return backtest.poisson_events(backtest.history_events(history, asked, "hist"), "expected_home", "expected_away", "poisson")


def test_fixtures_are_counted_before_they_are_repeated_for_every_weight(large):
    both = both_models(large)
    table = backtest.swept_summary(both.unionByName(both.filter("fixture_id = 'f7'")), "poisson", "hist", (0, 70, 100))
    assert not any("fixture_id" in c and "weight" in c for c in exchanged(table))
    want = {r.weight: r for r in backtest.summary(backtest.losses(backtest.sweep(both.unionByName(both.filter("fixture_id = 'f7'")), "poisson", "hist", (0, 70, 100))), ["weight"]).collect()}
    got = table.collect()
    assert len(got) == 3 and {r.fixtures for r in got} == {40}
    for r in got:
        assert r.asDict() == pytest.approx(want[r.weight].asDict())
    assert backtest.swept_summary(both.limit(0), "poisson", "hist").collect() == []


def test_ratios_shuffle_residuals_before_their_treatments(large):
    rows = [(f"f{k}", dt.date(2020, 1, 1) + dt.timedelta(k), k % 3, k % 2, 20.0 + k % 11, 21.0 + k % 4) for k in range(60)]
    frame = large.createDataFrame(rows, "fixture_id string, match_date date, team_id int, is_home int, observed double, expected double").selectExpr("*", "observed - expected AS residual")
    made = [residuals.predictions(residuals.treated(residuals.flagged(frame, team_order=order))) for order in (True, False)]
    assert [len(exchanged(x)) for x in made] == [1, 1] and not any(c.startswith(("observed_", "mu")) for c in exchanged(made[0])[0])
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got, want = ({r.fixture_id: r.asDict() for r in x.collect()} for x in made)
    assert got == want and len(got) == 60


@pytest.mark.parametrize("name", ["l5_leaderboard", "l6_gain_on_raw"])
def test_leaderboards_shuffle_no_treatment(large, name):
    shuffles = exchanged(catalog.QUERIES[name](large, SF))
    assert any("team_id" in c for c in shuffles) and not any(x.startswith("observed_") for c in shuffles for x in c)


@pytest.mark.parametrize("name", ["k7_weight_summary", "k12_final_weights"])
def test_weight_summaries_shuffle_no_row_a_fixture_and_weight(large, name):
    assert not any("fixture_id" in c and "weight" in c for c in exchanged(catalog.QUERIES[name](large, SF)))


def test_repricing_reads_the_raw_multipliers_of_the_strength_table(large):
    rebuild.expectations(large, SF)
    before = tables(large)
    frame = catalog.QUERIES["m2_repriced"](large, SF)
    assert tables(large) == before and len(exchanged(frame)) <= 3 and frame.count() > 0
