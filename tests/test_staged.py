"""A staged rebuild: skipped, continued and incremental steps give the tables of a full one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import form, strength
from oddsmill.plans import staged

SCHEMA = "fixture_id string, season int, match_date date, home_team_id long, away_team_id long, home_score int, away_score int"
AS_OF = "2003-01-01"


def matches(n=160, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        day = dt.date(2000, 1, 1) + dt.timedelta(6 * k)
        h, a = rng.sample(range(1, 7), 2)
        out.append((f"{day}_{k}", day.year, day, h, a, rng.randrange(4, 40), rng.randrange(4, 40)))
    return out


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture
def made(spark, tmp_path):
    return lambda name: staged.Rebuild(spark, f"file://{tmp_path}/{name}", AS_OF)


def test_late_season_equals_a_full_rebuild(spark, made):
    known = matches()
    wrong = [(*m[:5], m[5] + 3, m[6]) if m[0] == known[150][0] else m for m in known]
    future = spark.createDataFrame([("next", 2003, dt.date(2003, 2, 1), 1, 2)], "fixture_id string, season int, match_date date, home_team_id long, away_team_id long")
    late = made("late")
    late.load(spark.createDataFrame([m for m in wrong if m[1] != 2001], SCHEMA))
    late.run(future)
    late.load(spark.createDataFrame([m for m in known if m[1] == 2001 or m[0] == known[150][0]], SCHEMA))
    before = late.line("form").path
    late.run(future)
    assert late.line("results").changed_from == min(m[2] for m in known if m[1] == 2001)
    full = made("full")
    full.load(spark.createDataFrame(known, SCHEMA))
    full.run(future)
    for step in ("results", "form", "strength", "expected", "predictions", "matrix"):
        a, b = late.table(step), full.table(step)
        assert rows(a.select(*b.columns)) == rows(b), step
    # Form before the first changed date was carried over, not made again.
    day = F.lit(late.line("results").changed_from)
    old = spark.read.parquet(before).filter(F.col("match_date") < day)
    assert rows(late.table("form").filter(F.col("match_date") < day).select(*old.columns)) == rows(old) and old.count() > 0


def test_steps_that_are_done_are_skipped(spark, made):
    first = made("same")
    first.load(spark.createDataFrame(matches(60), SCHEMA))
    # Stopped after two steps; another program goes on.
    first.step("form", ["results"], first._form)
    future = spark.createDataFrame([], "fixture_id string, season int, match_date date, home_team_id long, away_team_id long")
    again = made("same")
    again.run(future)
    assert again.made == ["strength", "expected", "predictions", "matrix"]
    last = made("same")
    last.load(spark.createDataFrame(matches(60)[:20], SCHEMA))  # nothing new
    last.run(future)
    assert last.made == []


def test_a_step_that_fails_leaves_the_snapshot_before(spark, made):
    built = made("failed")
    built.load(spark.createDataFrame(matches(40), SCHEMA))
    built.step("form", ["results"], built._form)
    path = built.line("form").path
    built.load(spark.createDataFrame([(*matches(41)[40][:6], 7)], SCHEMA))

    def broken():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        built.step("form", ["results"], broken)
    assert built.line("form").path == path and built.table("form").count() == 80
    with pytest.raises(ValueError):
        built.load(spark.createDataFrame([("x", 2000, dt.date(2000, 1, 1), 1, 2, -5, 3)], SCHEMA))


@pytest.mark.parametrize("bad", [{"n": 0}, {"window": 0}, {"prior": 0}, {"passes": -1}, {"cap_start": 0.0}, {"rate": -0.1}])
def test_a_build_refuses_parameters_that_are_not_positive(spark, bad):
    with pytest.raises(ValueError, match="positive"):
        strength.strength(form.team_matches(spark.createDataFrame(matches(5), SCHEMA)), **bad)
