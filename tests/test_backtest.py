"""Backtest parts against plain Python: decayed sums, events without cells, bootstrap sums, grid moments."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.operators import backtest, residuals

START = dt.date(1990, 1, 1)


def weight(days):
    y = days / 365.25
    return 1.0 if y <= 2 else 0.5 if y <= 4 else 0.5 * 0.5 ** ((y - 4) / 2)


def matches(n, seed, span=4000, most=12):
    rng = random.Random(seed)
    # Many of the days lie at the edges of the weights before one another.
    days = [rng.randrange(span) for _ in range(n // 2)]
    days += [max(d - k, 0) for d, k in zip(days, [729, 730, 731, 1460, 1461, 1462, 1, 0] * n, strict=False)]
    return [(START + dt.timedelta(d), rng.randrange(most), rng.randrange(most)) for d in days]


def test_decayed_sums(spark):
    rows = [(m[1] % 3, m[0], 1 + m[2] % 2) for m in matches(400, 1)]
    asked = sorted({(b, START + dt.timedelta(d)) for b in range(4) for d in (0, 1, 500, 731, 1462, 3000, 4001)})
    counts = spark.createDataFrame(rows, "bin int, match_date date, n int")
    got = backtest.decayed_sums(counts, spark.createDataFrame(asked, "bin int, as_of date"), ["bin"])
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    found = {(r.bin, r.as_of): r for r in got.collect()}
    assert len(found) == len(asked)
    for b, day in asked:
        past = [(n, weight((day - d).days)) for c, d, n in rows if c == b and d < day]
        assert found[b, day].w == pytest.approx(sum(n * w for n, w in past), abs=1e-9) and found[b, day].n == sum(n for n, _ in past)


@pytest.mark.parametrize("max_score", [9, 15])
def test_events_equal_those_of_the_matrices(spark, max_score):
    history = spark.createDataFrame([*matches(600, 2), (None, 1, 1), (START, None, 2)], "match_date date, home_score int, away_score int")
    rng = random.Random(3)
    asked = [(k, START + dt.timedelta(rng.choice([1, 700, 1500, 2500, 3900, 5000])), rng.randrange(14), rng.randrange(14), rng.choice([-0.5, 3.5, 8.5, 17.5, 29.5, 40.5]), rng.choice([-20.5, -3.5, -0.5, 2.5, 9.5, 30.5])) for k in range(60)]
    frame = spark.createDataFrame(asked, "fixture_id int, as_of date, ah int, aa int, total_line double, margin_line double")
    matrices = backtest.walk_forward(history, frame.select(F.col("as_of").alias("match_date")), max_score, least=100)
    cells = {}
    for r in matrices.collect():
        cells.setdefault(r.as_of, {"elsewhere": r.elsewhere})[r.home_score, r.away_score] = r.p
    events = backtest.history_events(history, frame, "x", max_score, least=100)
    assert "NestedLoop" not in events._jdf.queryExecution().toString()
    got = {r.fixture_id: r for r in events.collect()}
    assert got and set(got) == {a[0] for a in asked if a[1] in cells}
    for k, day, ah, aa, total, margin in asked:
        if day not in cells:
            continue
        p = {(i, j): cells[day].get((i, j), cells[day]["elsewhere"]) for i in range(max_score + 1) for j in range(max_score + 1)}
        assert sum(p.values()) == pytest.approx(1)
        want = {
            "p_score": p[min(ah, max_score), min(aa, max_score)], "p_home": sum(v for (i, j), v in p.items() if i > j), "p_draw": sum(v for (i, j), v in p.items() if i == j), "p_away": sum(v for (i, j), v in p.items() if i < j),
            "p_over": sum(v for (i, j), v in p.items() if i + j > total), "p_cover": sum(v for (i, j), v in p.items() if i - j > margin), "home_mean": sum(i * v for (i, j), v in p.items()), "away_mean": sum(j * v for (i, j), v in p.items()),
        }
        for c, v in want.items():
            assert got[k][f"x_{c}"] == pytest.approx(v, abs=1e-9), c


def test_a_matrix_holds_earlier_matches_alone(spark):
    past = [(START + dt.timedelta(k), 3, 1) for k in range(120)]
    both = spark.createDataFrame([*past, (START + dt.timedelta(120), 9, 9)], "match_date date, home_score int, away_score int")
    day = spark.createDataFrame([(START + dt.timedelta(120),)], "match_date date")
    assert [(r.home_score, r.away_score) for r in backtest.walk_forward(both, day).collect()] == [(3, 1)]
    assert backtest.walk_forward(both, day, least=121).collect() == []


def test_poisson_events(spark):
    most = 10
    rows = [(0, 2.5, 3.5, 1, 2, 4.5, -1.5), (1, 0.0, 4.0, 0, 4, 3.5, 0.5), (2, 9.0, 12.0, 10, 11, 20.5, 10.5), (3, 1.0, 1.0, 0, 0, -0.5, -10.5), (4, None, 1.0, 0, 0, 0.5, 0.5), (5, -1.0, 1.0, 0, 0, 0.5, 0.5)]
    frame = spark.createDataFrame(rows, "k int, eh double, ea double, ah int, aa int, total_line double, margin_line double")
    got = {r.k: r for r in backtest.poisson_events(frame, "eh", "ea", "p", most).collect()}

    def folded(m):
        p = [math.exp(-m) * m**k / math.factorial(k) for k in range(most)]
        return [*p, 1 - sum(p)]

    for k, eh, ea, ah, aa, total, margin in rows[:4]:
        h, a = folded(eh), folded(ea)
        p = {(i, j): h[i] * a[j] for i in range(most + 1) for j in range(most + 1)}
        want = {
            "p_score": p[min(ah, most), min(aa, most)], "p_home": sum(v for (i, j), v in p.items() if i > j), "p_draw": sum(v for (i, j), v in p.items() if i == j), "p_away": sum(v for (i, j), v in p.items() if i < j),
            "p_over": sum(v for (i, j), v in p.items() if i + j > total), "p_cover": sum(v for (i, j), v in p.items() if i - j > margin), "home_mean": sum(i * v for (i, j), v in p.items()), "away_mean": sum(j * v for (i, j), v in p.items()),
        }
        for c, v in want.items():
            assert got[k][f"p_{c}"] == pytest.approx(v, abs=1e-12), (k, c)
    assert got[4].p_p_home is None and got[5].p_p_over is None


def test_draws_are_poisson_and_differ_between_samples():
    rng = np.random.default_rng(0)
    first, second = rng.integers(0, backtest.PRIME, 500), rng.integers(0, backtest.PRIME, 500)
    n = backtest.draw_counts(first, second, 2000)
    assert n.mean() == pytest.approx(1, abs=0.01) and n.var() == pytest.approx(1, abs=0.02)
    assert np.bincount(n.ravel())[:3] / n.size == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-1) / 2], abs=0.003)
    # The spread of a mean over samples is that of independent draws.
    x = rng.standard_normal(500)
    means = (n * x[:, None]).sum(axis=0) / n.sum(axis=0)
    assert means.std() == pytest.approx(x.std() / math.sqrt(500), rel=0.1)
    assert abs(np.corrcoef(n[:, 0], n[:, 1])[0, 1]) < 0.15


def test_bootstrap_equals_plain_sums(spark):
    rng = random.Random(5)
    rows = [(f"f{k}", w, rng.random(), rng.random()) for k in range(300) for w in (0, 70)] + [("lost", 70, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "fixture_id string, weight int, a double, b double").repartition(7)
    got = {r.metric: r for r in backtest.bootstrap(frame, ("a", "b"), (70,), samples=50).collect()}
    seeds = {r.fixture_id: (r.s, r.t) for r in spark.createDataFrame([(f"f{k}",) for k in range(300)], "fixture_id string").select("fixture_id", *[s.alias(n) for s, n in zip(backtest.draw_seeds(F.col("fixture_id"), 42), "st", strict=True)]).collect()}
    ids = sorted(seeds)
    counts = backtest.draw_counts(*(np.array([seeds[i][k] for i in ids]) for k in (0, 1)), 50)
    for c, metric in ((2, "a"), (3, "b")):
        own = {(r[0], r[1]): r[c] for r in rows}
        d = np.array([own[i, 70] - own[i, 0] for i in ids])
        means = (counts * d[:, None]).sum(axis=0) / counts.sum(axis=0)
        assert got[metric].mean == pytest.approx(means.mean()) and got[metric].share_better == pytest.approx((means < 0).mean())
        assert (got[metric].low, got[metric].high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_grid_moments_equal_repricing_at_every_point(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(60)), rng.uniform(5, 45), rng.uniform(0.4, 1.9), rng.uniform(0.4, 1.9)) for _ in range(500)]
    points = residuals.grid([0.3, 0.75], [0.2, 0.8], [0.5, 1.0])
    frame = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0)], "observed double, expected double, attack double, opponent_defence double").repartition(5)
    got = {r.point: r for r in residuals.curve_grid(frame, points).collect()}
    assert sorted(got) == list(range(8))
    for k, cap, edit, rate in points:
        own = residuals.repriced(spark.createDataFrame(rows, frame.schema), cap, edit, rate).collect()
        p, o = np.array([r.predicted for r in own]), np.array([r.observed for r in own])
        r = got[k]
        assert r.n == 500 and (r.bias, r.mae, r.rmse, r.correlation) == pytest.approx(((p - o).mean(), abs(p - o).mean(), math.sqrt(((p - o) ** 2).mean()), np.corrcoef(p, o)[0, 1]))
