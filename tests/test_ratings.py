"""Season ratings against a dense fit by Newton steps, and predictions from them."""

import math

import numpy as np
import pytest

from oddsmill.operators import ratings

SCHEMA = "season string, team string, opponent string, is_home double, tries double"


def dense(rows):
    """Coefficients by name of ``tries ~ home + team + opponent`` of one season, by iteratively weighted least squares."""
    teams, opponents = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    names = ["intercept", "home", *[("team", t) for t in teams[1:]], *[("opponent", t) for t in opponents[1:]]]
    x = np.array([[1.0, r[3], *[float(r[1] == t) for t in teams[1:]], *[float(r[2] == t) for t in opponents[1:]]] for r in rows])
    y = np.array([r[4] for r in rows])
    b = np.zeros(len(names))
    b[0] = np.log(y.mean())
    for _ in range(60):
        mu = np.exp(x @ b)
        b = b + np.linalg.lstsq(x.T @ (x * mu[:, None]), x.T @ (y - mu), rcond=None)[0]
    return dict(zip(names, b, strict=True))


def season(name, teams, games, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(games):
        i, j = rng.choice(teams, 2, replace=False)
        i, j = (k % teams, (k + 1) % teams) if k < teams else (i, j)
        out += [(name, f"t{i:02d}", f"t{j:02d}", 1.0, float(rng.poisson(3 + i % 4) / 1.3)), (name, f"t{j:02d}", f"t{i:02d}", 0.0, float(rng.poisson(2 + j % 3) / 1.3))]
    return out


@pytest.mark.parametrize(("teams", "games"), [(4, 40), (12, 30), (9, 200)])
def test_every_season_equals_its_own_dense_fit(spark, teams, games):
    rows = season("2001", teams, games, 1) + season("2002", teams + 1, 2 * games, 2)
    extra = [(None, "t00", "t01", 1.0, 9.0), ("2001", "t00", "t01", 1.0, None)]
    got = {(r.season, r.team): r for r in ratings.coefficients(ratings.fit(spark.createDataFrame(rows + extra, SCHEMA))).collect()}
    for name in ("2001", "2002"):
        own = [r for r in rows if r[0] == name]
        want = dense(own)
        for team in sorted({r[1] for r in own}):
            r = got[name, team]
            assert r.team_effect == pytest.approx(want.get(("team", team), 0.0), abs=1e-6)
            assert r.opponent_effect == pytest.approx(want.get(("opponent", team), 0.0), abs=1e-6)
            assert r.home_effect == pytest.approx(want["home"], abs=1e-6) and r.intercept == pytest.approx(want["intercept"], abs=1e-6)


def test_more_teams_than_a_feature_vector_holds(spark):
    n = 2500
    pairs = spark.range(n * 6).selectExpr("id % 2500 i", "(id * 7 + 11 + id div 2500 * 131) % 2500 j", "2 + id % 5 y").filter("i <> j")
    home = pairs.selectExpr("'1' season", "CAST(i AS STRING) team", "CAST(j AS STRING) opponent", "1D is_home", "CAST(y AS DOUBLE) tries")
    away = pairs.selectExpr("'1' season", "CAST(j AS STRING) team", "CAST(i AS STRING) opponent", "0D is_home", "CAST(y AS DOUBLE) * 0.8 tries")
    rows = home.unionByName(away)
    fitted = ratings.fit(rows)
    assert fitted.count() == n
    sides = rows.selectExpr("monotonically_increasing_id() fixture_id", "season", "team home_team", "opponent away_team", "is_home", "tries")
    home_effect = fitted.first().home
    expected = f"expected_home_tries / IF(is_home = 1, 1D, {home_effect!r}D)"
    both = ratings.expected_tries(fitted, sides).selectExpr("home_team", "away_team", "tries", f"{expected} e")
    # The likelihood equations: expected and scored tries agree for every team and every opponent.
    for side in ("home_team", "away_team"):
        sums = both.groupBy(side).agg({"tries": "sum", "e": "sum"})
        assert sums.count() == n and sums.selectExpr("max(abs(`sum(tries)` - `sum(e)`) / `sum(tries)`)").first()[0] < 1e-6


def test_teams_without_tries(spark):
    rows = [("1", "a", "b", 1.0, 0.0), ("1", "b", "a", 0.0, 3.0), ("1", "a", "c", 1.0, 0.0), ("1", "c", "a", 0.0, 2.0), ("1", "b", "c", 1.0, 4.0), ("1", "c", "b", 0.0, 1.0)]
    fitted = ratings.fit(spark.createDataFrame(rows, SCHEMA))
    got = {r.team: r for r in fitted.collect()}
    assert got["a"].attack == 0.0 and got["b"].attack > 0
    effects = {r.team: r for r in ratings.coefficients(fitted).collect()}
    assert effects["a"].team_effect is None and effects["b"].opponent_effect is not None
    assert ratings.fit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_predictions_and_unseen_teams(spark):
    fitted = spark.createDataFrame([("1", "a", 4.0, 0.5, 1.2), ("1", "b", 3.0, 2.0, 1.2)], "season string, team string, attack double, defence double, home double")
    fixtures = spark.createDataFrame([(1, "1", "a", "b"), (2, "1", "a", "x"), (3, "2", "a", "b")], "fixture_id int, season string, home_team string, away_team string")
    rows = ratings.expected_tries(fitted, fixtures).collect()
    assert [(r.fixture_id, r.expected_home_tries, r.expected_away_tries) for r in rows] == [(1, pytest.approx(9.6), pytest.approx(1.5))]
    assert sorted((r.fixture_id, r.team) for r in ratings.unseen(fitted, fixtures).collect()) == [(2, "x"), (3, "a"), (3, "b")]
    with pytest.raises(ValueError, match="x"):
        ratings.expected_tries(fitted, fixtures, strict=True)


@pytest.mark.parametrize(("home", "away"), [(4.2, 3.1), (0.0, 2.0), (0.0, 0.0), (25.0, 1.0)])
def test_chances_equal_those_of_the_cells(spark, home, away):
    pmf = lambda m, k: math.exp(-m) * m**k / math.factorial(k)
    cells = {(i, j): pmf(home, i) * pmf(away, j) for i in range(17) for j in range(17)}
    total = sum(cells.values())
    r = ratings.match_chances(spark.createDataFrame([(1, home, away)], "k int, h double, a double"), ["k"], "h", "a").first()
    for got, held in ((r.home, lambda i, j: i > j), (r.draw, lambda i, j: i == j), (r.away, lambda i, j: i < j)):
        assert got == pytest.approx(sum(p for c, p in cells.items() if held(*c)) / total, abs=1e-12)
