"""Distributions and prices: invariants and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.functions import rating as fx
from oddsmill.operators import distributions as ds
from oddsmill.operators import markets
from oddsmill.plans import rebuild

HISTORY = [(20, 10), (24, 20), (30, 18), (12, 24), (36, 16), (18, 14)]


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([(h, a, f"20{10 + k}-01-01") for k, (h, a) in enumerate(HISTORY)], "home_score int, away_score int, d string").withColumn("match_date", F.to_date("d"))


@pytest.mark.parametrize(("mean", "most"), [(24.0, 100), (0.0, 10), (26 / 18, 100)])
def test_poisson(spark, mean, most):
    got = {r.k: r.p for r in ds.poisson(spark.createDataFrame([(mean,)], "m double"), "m", most).collect()}
    assert sum(got.values()) == pytest.approx(1) and sum(k * p for k, p in got.items()) == pytest.approx(mean, abs=1e-6)
    if mean == 0:
        assert got[0] == 1


def test_poisson_tails(spark):
    one = spark.createDataFrame([(5.0,)], "m double")
    plain = lambda k: math.exp(-5 + k * math.log(5) - math.lgamma(k + 1))
    left = {r.k: r.p for r in ds.poisson(one, "m", 6, "leave").collect()}
    fold = {r.k: r.p for r in ds.poisson(one, "m", 6, "fold").collect()}
    assert left[6] == pytest.approx(plain(6)) and sum(fold.values()) == pytest.approx(1) and fold[3] == pytest.approx(plain(3))
    assert ds.poisson(spark.createDataFrame([(-1.0,)], "m double"), "m", 3).filter("p IS NOT NULL").isEmpty()


def test_joint_cells_are_products(spark):
    rows = spark.createDataFrame([(1, 20.0, 14.0), (2, 14.0, 20.0)], "id int, h double, a double")
    cells = {(r.id, r.home_score, r.away_score): r.p for r in ds.poisson_cells(rows, ["id"], "h", "a", 60).collect()}
    assert all(cells[1, i, j] == pytest.approx(cells[2, j, i]) for i in range(0, 61, 7) for j in range(0, 61, 9))


def test_weights_by_age(spark, history):
    got = {(r.home_score, r.away_score): r.p for r in ds.historical(history, "2016-01-01").collect()}
    weights = [0.25, 0.25, 0.5, 0.5, 1.0, 1.0]
    assert got == {c: pytest.approx(w / sum(weights)) for c, w in zip(HISTORY, weights, strict=True)}
    assert ds.historical(history, "2012-06-01", strict=True).count() == 3
    assert [r.w for r in spark.createDataFrame([(-1.0,), (3.0,), (6.0,)], "y double").select(fx.decay_weight(F.col("y")).alias("w")).collect()] == [1.0, 0.5, 0.25]


@pytest.mark.parametrize(("strength", "want"), [(1.0, (30.0, 16.0)), (0.0, (140 / 6, 102 / 6))])
def test_shifted_means(spark, history, strength, want):
    targets = spark.createDataFrame([(1, 30.0, 16.0)], "id int, h double, a double")
    cells = ds.shifted(history, targets, ["id"], "h", "a", strength=strength)
    row = ds.implied_means(cells, ["id"]).first()
    assert (row.home_mean, row.away_mean) == pytest.approx(want)
    assert ds.matrix_rules(cells, ["id"]).first().ok


def test_blend(spark, history):
    targets = spark.createDataFrame([(1, 30.0, 16.0)], "id int, h double, a double")
    a, b = ds.poisson_cells(targets, ["id"], "h", "a", 60), ds.shifted(history, targets, ["id"], "h", "a")
    none = {(r.home_score, r.away_score): r.p for r in ds.blended(a, b, ["id"], 0.0).collect()}
    assert all(none[r.home_score, r.away_score] == pytest.approx(r.p) for r in a.collect())
    assert ds.blended(a, b, ["id"], 0.3).agg(F.sum("p")).first()[0] == pytest.approx(1)
    for w in (-0.1, 1.1):
        with pytest.raises(ValueError):
            ds.blended(a, b, ["id"], w)


def test_tilt_meets_reachable_means_and_saturates():
    marginal = np.full(11, 1 / 11)
    k = np.arange(11)
    for target, theta in zip((2.0, 5.0, 9.5), ds.solve_tilt(marginal, np.array([2.0, 5.0, 9.5])), strict=True):
        w = marginal * np.exp(theta * k)
        assert (w * k).sum() / w.sum() == pytest.approx(target, abs=1e-8)
    assert ds.solve_tilt(marginal, np.array([50.0]))[0] == pytest.approx(10.0)


def test_array_prices_equal_cell_prices(spark, history):
    base = ds.historical(history, "2016-01-01")
    fixtures = spark.createDataFrame([("x", 26.0, 17.0), ("y", 19.5, 21.25)], "fixture_id string, expected_home double, expected_away double")
    got = {(r.fixture_id, r.market, r.selection, r.line): r.probability for r in rebuild.priced(fixtures, base).collect()}
    cells = ds.tilted_cells(base, ds.tilts(base, fixtures, "expected_home", "expected_away"), ["fixture_id"])
    keys = ["fixture_id"]
    plain = [
        markets.match_odds(cells, keys), markets.handicap_ladder(markets.margins(cells, keys), fixtures, keys, "expected_home", "expected_away"),
        markets.totals_ladder(markets.totals(cells, keys), keys),
    ]
    want = {(r.fixture_id, r.market, r.selection, r.line): r.probability for df in plain for r in df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for f in ("x", "y"):
        overs = [p for (i, m, s, _), p in sorted(want.items(), key=lambda x: x[0][3] or 0) if i == f and m == "totals" and s == "over"]
        assert overs == sorted(overs, reverse=True) and len(overs) in (41, 42)
        assert sum(p for (i, m, _, _), p in want.items() if i == f and m == "match_odds") == pytest.approx(1)


def test_mainlines(spark):
    one = spark.createDataFrame([(28.4, 21.7)], "h double, a double").select(markets.handicap_mainline(F.col("h"), F.col("a")).alias("x")).first()
    assert one.x == -6.5
    ladder = spark.createDataFrame([(1, "over", 40.5, 0.6), (1, "over", 41.5, 0.4), (1, "over", 42.5, 0.3)], "id int, selection string, line double, probability double")
    assert markets.totals_mainline(ladder, ["id"]).first().line == 40.5
    assert spark.createDataFrame([(0.0,)], "p double").select(fx.price(F.col("p")).alias("x")).first().x == float("inf")


def test_joint_tilt_is_exact(spark):
    base = spark.createDataFrame([(1, i, j, 1.0 + (i == j) * 3) for i in range(9) for j in range(9)], "g int, home_score int, away_score int, p double")
    wanted = spark.createDataFrame([(1, "k", 3.0, 5.5)], "g int, id string, h double, a double")
    t = ds.joint_tilts(base, wanted, "g", "id", "h", "a", 8).first()
    w = {(r.home_score, r.away_score): r.p * math.exp(t.theta_home * r.home_score + t.theta_away * r.away_score) for r in base.collect()}
    mass = sum(w.values())
    assert sum(i * p for (i, _), p in w.items()) / mass == pytest.approx(3.0) and sum(j * p for (_, j), p in w.items()) / mass == pytest.approx(5.5)


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_joint_tilts_of_groups_by_either_path(spark, most_bytes):
    cells = [(g, i, j, 1.0 + g * (i == j) + (i * j) % 3) for g in (1, 2) for i in range(9) for j in range(9)]
    base = spark.createDataFrame(cells, "g int, home_score int, away_score int, p double")
    wanted = [(1 + k % 3, f"k{k}", 1.0 + k % 6, 7.0 - k % 5) for k in range(40)] + [(1, "none", None, 3.0)]
    frame = spark.createDataFrame(wanted, "g int, id string, h double, a double").repartition(3)
    out = ds.joint_tilts(base, frame, "g", "id", "h", "a", 8, most_bytes=most_bytes)
    assert ("CoGroup" in out._jdf.queryExecution().toString()) == (most_bytes == 0)
    got = {r.id: (r.theta_home, r.theta_away) for r in out.collect()}
    assert set(got) == {k for g, k, h, _ in wanted if g < 3 and h is not None}
    for g, k, h, a in wanted:
        if k in got:
            w = {(i, j): p * math.exp(got[k][0] * i + got[k][1] * j) for c, i, j, p in cells if c == g}
            mass = sum(w.values())
            assert sum(i * p for (i, _), p in w.items()) / mass == pytest.approx(h) and sum(j * p for (_, j), p in w.items()) / mass == pytest.approx(a)


def test_unreachable_means_are_an_error():
    with pytest.raises(ValueError, match="no tilt"):
        ds.solve_joint_tilt(np.ones((4, 4)), np.array([1.0, 9.0]), np.array([1.0, 1.0]))


@pytest.mark.parametrize("strength", [0.0, 0.5, 1.0])
def test_shifted_matrices_by_hand(spark, strength):
    lines = [(3, 1), (3, 1), (0, 2), (7, 5), (4, 4), (None, 3)]
    history = spark.createDataFrame(lines, "home_score int, away_score int")
    targets = [("x", 5.5, 2.0), ("y", 0.0, 9.0), ("z", 50.0, 1.0), ("none", None, 1.0)]
    got = {}
    for r in ds.shifted(history, spark.createDataFrame(targets, "id string, h double, a double"), ["id"], "h", "a", 10, strength).collect():
        got.setdefault(r.id, {})[r.home_score, r.away_score] = r.p
    known = [x for x in lines if x[0] is not None]
    means = [sum(x[k] for x in known) / len(known) for k in (0, 1)]
    assert set(got) == {"x", "y", "z"}
    for name, *goal in targets[:3]:
        want = {}
        for line in known:
            sides = []
            for score, mean, target in zip(line, means, goal, strict=True):
                x = min(max(score * ((target / mean) ** strength if target > 0 else 0.0), 0.0), 10.0)
                sides.append([(int(x), 1 - (x - int(x))), (int(x) + 1, x - int(x))])
            for i, v in sides[0]:
                for j, w in sides[1]:
                    if v * w > 0:
                        want[i, j] = want.get((i, j), 0.0) + v * w / len(known)
        assert got[name] == pytest.approx(want)
