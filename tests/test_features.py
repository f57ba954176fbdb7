"""Hand-computed values for form, factors, strength and as-of lookups; leaks and edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import rating as fx
from oddsmill.operators import expected, form, integrity, strength, trailing

D = dt.date


def results(spark, rows):
    return spark.createDataFrame(rows, "fixture_id string, season int, match_date date, home_team_id long, home_score int, away_team_id long, away_score int")


def league(spark, seed=1, n=120, teams=6):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        h, a = draw.sample(range(teams), 2)
        rows.append((f"f{k:04d}", 2020, D(2020, 1, 1) + dt.timedelta(days=k // 3), h, draw.randint(0, 50), a, draw.randint(0, 50)))
    return rows


def test_factor_chain(spark):
    rows = [("a", 2026, D(2026, 1, 1), 1, 30, 2, 10), ("b", 2026, D(2026, 1, 8), 1, 20, 2, 20), ("c", 2026, D(2026, 1, 15), 1, 40, 2, 10)]
    got = {r.fixture_id: (r.league_average, r.home_factor, r.away_factor) for r in expected.fixture_factors(results(spark, rows)).collect()}
    assert got["a"] == (None, None, None)
    assert got["b"] == pytest.approx((20, 1.5, 0.5)) and got["c"] == pytest.approx((20, 1.25, 0.75))


def test_factors_of_one_day_are_equal(spark):
    rows = [("a", 2026, D(2026, 1, 1), 1, 30, 2, 10), ("b", 2026, D(2026, 1, 8), 1, 50, 2, 0), ("c", 2026, D(2026, 1, 8), 3, 10, 4, 40)]
    got = {r.fixture_id: (r.league_average, r.home_factor, r.away_factor) for r in expected.fixture_factors(results(spark, rows)).collect()}
    assert got["b"] == got["c"] == pytest.approx((20, 1.5, 0.5))


def test_violations(spark):
    rows = [("a", 2026, D(2026, 1, 1), 1, 30, 2, 10), ("a", 2026, D(2026, 1, 8), 1, -1, 2, 0), ("c", 2026, D(2026, 1, 8), 3, None, 3, 40)]
    found = {(r.rule, r.key) for r in integrity.report(*integrity.results_rules(results(spark, rows))).collect()}
    assert found == {("unique(fixture_id)", "a"), ("points >= 0", "a"), ("not_null(home_score)", "c"), ("two teams", "c")}
    with pytest.raises(integrity.Violated):
        integrity.report(*integrity.results_rules(results(spark, rows)), strict=True)
    assert integrity.has_columns(results(spark, rows), ["fixture_id", "nope"], "results").collect()[0].detail == "nope"


def test_form_of_first_games(spark):
    rows = league(spark)
    got = form.recent_form(form.team_matches(results(spark, rows)), (2, 5)).collect()
    by_team = {}
    for r in sorted(got, key=lambda r: (r.match_date, r.fixture_id)):
        past = by_team.setdefault(r.team_id, [])
        assert r.prior_games == len(past) and r.games_used_2 == len(past[-2:])
        assert r.avg_for_5 == (pytest.approx(sum(past[-5:]) / len(past[-5:])) if past else None)
        past.append(r.points_for)
    with pytest.raises(ValueError):
        form.recent_form(form.team_matches(results(spark, rows)), (0,))


@pytest.mark.parametrize(("bucket", "parts"), [(7, 3), (50, 1), (5, 5), (100_000, 4)])
def test_trailing_mean_equals_the_plain_window(spark, bucket, parts):
    draw = random.Random(bucket)
    values = [draw.random() for _ in range(101)]
    df = spark.createDataFrame([(k // 2, k, v) for k, v in enumerate(values)], "d int, k int, v double")
    got = {r.k: r.m for r in trailing.trailing_mean(df.orderBy("v"), ["d", "k"], "v", 5, "m", bucket, parts).collect()}
    for k in range(101):
        past = values[max(0, k - 5) : k]
        assert got[k] == (pytest.approx(sum(past) / len(past)) if past else None)


def plain_strength(rows, passes):
    """The fixpoint row by row."""
    fixtures = sorted(rows, key=lambda r: (r[2], r[0]))
    means, mean_of = [], {}
    for r in fixtures:
        mean_of[r[0]] = sum(means[-50:]) / len(means[-50:]) if means else None
        means.append((r[4] + r[6]) / 2)
    team = [(r[0], own, other, pf, pa) for r in fixtures for own, other, pf, pa in ((r[3], r[5], r[4], r[6]), (r[5], r[3], r[6], r[4]))]

    def multipliers(points):
        past, out = {}, {}
        for f, own, _, _, _ in team:
            mine, lg = past.setdefault(own, []), mean_of[f]
            last = mine[-5:]
            n = len(last)
            for k in (0, 1):
                m = sum(x[k] for x in last) / n if n else lg
                out[f, own, k] = None if lg is None else (m * n + lg * 3) / (n + 3) / lg
            mine.append(points[f, own])
        return out

    now = multipliers({(f, own): (pf, pa) for f, own, _, pf, pa in team})
    for _ in range(passes):
        one = lambda v: 1.0 if v is None else v
        now = multipliers({(f, own): (pf / one(now[f, other, 1]), pa / one(now[f, other, 0])) for f, own, other, pf, pa in team})
    return now


def test_fixpoint(spark):
    rows = league(spark)
    got = strength.strength(form.team_matches(results(spark, rows)), passes=3).collect()
    want = plain_strength(rows, 3)
    for r in got:
        for k, v in ((0, r.attack), (1, r.defence)):
            assert v == (None if want[r.fixture_id, r.team_id, k] is None else pytest.approx(want[r.fixture_id, r.team_id, k]))
    assert sum(r.attack is None for r in got) == 2
    with pytest.raises(ValueError):
        strength.strength(form.team_matches(results(spark, rows)), passes=0)


def test_curve(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (0.0,), (1.25,)], "x double").select(fx.capped_curve(F.col("x"), 0.5, 0.25, 1.0).alias("y"))
    assert [r.y for r in rows.collect()] == pytest.approx([1.0, 1.25, 0.75, 1 + 0.25 * (2 * 0.5 - 0.25)])


def test_shrinking(spark):
    one = spark.createDataFrame([(40.0, 1, 20.0), (None, None, 20.0)], "o double, n int, l double")
    assert [r.s for r in one.select(fx.shrunk(F.col("o"), F.col("n"), F.col("l"), 3).alias("s")).collect()] == [25.0, 20.0]


def test_as_of_is_strict_and_ties_go_to_the_last_id(spark):
    builds = spark.createDataFrame([(1, D(2020, 1, 1), "a", 1.0), (1, D(2020, 1, 3), "b", 2.0), (1, D(2020, 1, 3), "c", 3.0), (2, D(2020, 1, 1), "d", 9.0)], "team_id long, match_date date, fixture_id string, v double")
    probes = spark.createDataFrame([("x", D(2020, 1, 1), 1), ("y", D(2020, 1, 3), 1), ("z", D(2020, 1, 4), 1), ("w", D(2020, 1, 4), 3)], "fixture_id string, match_date date, team_id long")
    got = {r.fixture_id: r.v for r in expected.as_of_last(probes, builds, ["team_id"], "match_date", ["v"], "fixture_id").collect()}
    assert got == {"x": None, "y": 1.0, "z": 3.0, "w": None}


def test_a_result_changes_nothing_before_it(spark):
    rows = league(spark, n=60)
    changed = [(*r[:4], 49, r[5], 0) if r[0] == "f0040" else r for r in rows]
    day = next(r[2] for r in rows if r[0] == "f0040")

    def early(which):
        power = strength.strength(form.team_matches(results(spark, which)), passes=2)
        out = expected.expected_scores(power, results(spark, which)).filter(F.col("match_date") < day)
        return sorted((r.fixture_id, r.expected_home, r.expected_away) for r in out.collect())

    assert early(rows) == early(changed) and early(rows)


def test_features_must_be_positive(spark):
    row = dict.fromkeys(expected.FEATURES, 1.0)
    good = spark.createDataFrame([{"fixture_id": "a", **row}, {"fixture_id": "b", **row, "away_defence": 0.0}])
    assert [r.fixture_id for r in expected.usable(good).collect()] == ["a"]
