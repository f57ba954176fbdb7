"""Opponent-adjusted attack and defence multipliers, iterated to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import capped_curve, shrunk
from oddsmill.operators.trailing import trailing_mean
from oddsmill.sources.storage import resting_on, written

FORM, LEAGUE, PRIOR, PASSES, TOLERANCE = 5, 50, 3, 10, 1e-4
SIDES = (("home", 1), ("away", 0))


def league_average(rows: DataFrame, window: int = LEAGUE, bucket: int | None = None) -> DataFrame:
    """Add the mean points of the ``window`` fixtures before each fixture; earlier ids of one day count."""
    fixtures = rows.groupBy("fixture_id", "match_date").agg(F.avg("points_for").alias("points"))
    means = trailing_mean(fixtures, ["match_date", "fixture_id"], "points", window, "league_average", bucket)
    return rows.join(means.select("fixture_id", "league_average"), "fixture_id")


def opponent_form(form: DataFrame, n: int = FORM) -> DataFrame:
    """Add the opponent's form before the match."""
    own = [f"avg_for_{n}", f"avg_against_{n}", f"games_used_{n}"]
    other = form.select("fixture_id", F.col("team_id").alias("opponent_id"), *[F.col(c).alias(f"opponent_{c}") for c in own])
    return form.join(other, ["fixture_id", "opponent_id"], "left")


def raw_multipliers(form: DataFrame, n: int = FORM, prior: float = PRIOR) -> DataFrame:
    league, games = F.col("league_average"), F.col(f"games_used_{n}")
    attack = F.try_divide(shrunk(F.col(f"avg_for_{n}"), games, league, prior), league)
    defence = F.try_divide(shrunk(F.col(f"avg_against_{n}"), games, league, prior), league)
    return form.withColumns({"raw_attack": attack, "raw_defence": defence})


def opponent_multipliers(rows: DataFrame) -> DataFrame:
    """Add the opponent's current multipliers ``opponent_attack, opponent_defence``; a missing one is 1."""
    other = rows.select("fixture_id", F.col("team_id").alias("opponent_id"), F.col("attack").alias("oa"), F.col("defence").alias("od"))
    both = rows.join(other, ["fixture_id", "opponent_id"], "left")
    return both.select(*rows.columns, F.coalesce("oa", F.lit(1.0)).alias("opponent_attack"), F.coalesce("od", F.lit(1.0)).alias("opponent_defence"))


def adjusted(rows: DataFrame) -> DataFrame:
    """Points adjusted for the opponent's current multipliers."""
    both = opponent_multipliers(rows)
    return both.select(*rows.columns, F.try_divide(F.col("points_for"), F.col("opponent_defence")).alias("adjusted_for"), F.try_divide(F.col("points_against"), F.col("opponent_attack")).alias("adjusted_against"))


def one_pass(rows: DataFrame, n: int = FORM, prior: float = PRIOR) -> DataFrame:
    """Multipliers from the previous adjusted games of each team."""
    before = Window.partitionBy("team_id").orderBy("match_date", "fixture_id").rowsBetween(-n, -1)
    league = F.col("league_average")
    rolled = adjusted(rows).withColumns({"f": F.avg("adjusted_for").over(before), "a": F.avg("adjusted_against").over(before), "g": F.count("adjusted_for").over(before)})
    attack = F.try_divide(shrunk(F.col("f"), F.col("g"), league, prior), league)
    defence = F.try_divide(shrunk(F.col("a"), F.col("g"), league, prior), league)
    change = F.greatest(F.abs(attack - F.col("attack")), F.abs(defence - F.col("defence")))
    kept = [c for c in rows.columns if c not in ("attack", "defence", "change")]
    return rolled.select(*kept, attack.alias("attack"), defence.alias("defence"), change.alias("change"))


def fixtures_of(matches: DataFrame) -> DataFrame:
    """One row a fixture from its two team rows, with the mean of their points."""
    side = lambda home, c: F.max(F.when(F.col("is_home") == home, F.col(c)))
    own = {f"{s}_{name}": side(h, c) for s, h in SIDES for name, c in (("team", "team_id"), ("points", "points_for"))}
    return matches.groupBy("fixture_id", "match_date").agg(*[x.alias(c) for c, x in own.items()], F.avg("points_for").alias("points"))


def next_state(state: DataFrame, n: int = FORM, prior: float = PRIOR) -> DataFrame:
    """``one_pass`` over fixtures: what opponents exchange meets in a fixture's row, so there is no join.

    state: place (in the order of date and id), league_average, each side's team and points and, but for the raw
    multipliers, both sides' multipliers.  Two shuffles of numbers, by team and back by place.
    """
    known = "home_attack" in state.columns

    def side(own: str, other: str, home: int):
        scored, conceded = F.col(f"{own}_points").cast("double"), F.col(f"{other}_points").cast("double")
        if known:
            scored, conceded = F.try_divide(scored, F.coalesce(f"{other}_defence", F.lit(1.0))), F.try_divide(conceded, F.coalesce(f"{other}_attack", F.lit(1.0)))
        was = [(F.col(f"{own}_{c}") if known else F.lit(None).cast("double")).alias(f"was_{c}") for c in ("attack", "defence")]
        return F.struct(F.lit(home).alias("is_home"), F.col(f"{own}_team").alias("team"), F.col(f"{own}_points").alias("points"), scored.alias("scored"), conceded.alias("conceded"), *was)

    rows = state.select("place", "league_average", F.explode(F.array(side("home", "away", 1), side("away", "home", 0))).alias("x")).select("place", "league_average", "x.*")
    before = Window.partitionBy("team").orderBy("place").rowsBetween(-n, -1)
    rolled = rows.withColumns({"f": F.avg("scored").over(before), "a": F.avg("conceded").over(before), "g": F.count("scored").over(before)})
    league = F.col("league_average")
    attack, defence = (F.try_divide(shrunk(F.col(c), F.col("g"), league, prior), league) for c in ("f", "a"))
    change = F.greatest(F.abs(attack - F.col("was_attack")), F.abs(defence - F.col("was_defence")))
    made = rolled.select("place", "is_home", "league_average", "team", "points", attack.alias("attack"), defence.alias("defence"), change.alias("change"))
    own = {f"{s}_{c}": F.max(F.when(F.col("is_home") == h, F.col(c))) for s, h in SIDES for c in ("team", "points", "attack", "defence")}
    # Dealt out before the grouping, as one before the shuffle would widen every row and merge none.
    return made.repartition("place").groupBy("place").agg(F.max("league_average").alias("league_average"), *[x.alias(c) for c, x in own.items()], F.max("change").alias("change"))


def iterated(raw: DataFrame, passes: int = PASSES, tolerance: float = TOLERANCE, n: int = FORM, prior: float = PRIOR) -> DataFrame:
    """Repeat ``next_state`` from the raw multipliers until none moves by ``tolerance``; each pass is written in place of the one before."""
    state = raw
    for _ in range(passes):
        state = written(next_state(state, n, prior), "strength", None if state is raw else state)
        moved = state.agg(F.max("change")).first()[0]
        if moved is None or moved < tolerance:
            break
    return state


def strength(matches: DataFrame, n: int = FORM, window: int = LEAGUE, prior: float = PRIOR, passes: int = PASSES, cap_start: float = 0.75, max_edit: float = 0.40, rate: float = 0.80) -> DataFrame:
    """Team rows (from ``team_matches``) with raw, iterated and scaled multipliers.

    A fixture is a row until the end, known by its place in the order; its id and date wait in one written table.
    """
    if min(n, window, passes) <= 0 or prior <= 0 or min(cap_start, max_edit, rate) <= 0:
        raise ValueError("parameters must be positive")
    means = trailing_mean(fixtures_of(matches), ["match_date", "fixture_id"], "points", window, "league_average", place="place")
    fixtures = written(means.drop("points"), "fixtures", means)
    raw = written(next_state(fixtures.drop("fixture_id", "match_date"), n, prior), "strength")
    last = iterated(raw, passes, TOLERANCE, n, prior)
    named = lambda state, prefix: state.select("place", *[F.col(f"{s}_{c}").alias(f"{s}_{prefix}{c}") for s, _ in SIDES for c in ("attack", "defence")])
    both = fixtures.join(named(raw, "raw_"), "place").join(named(last, ""), "place")

    def side(own: str, other: str, home: int):
        names = {"team_id": f"{own}_team", "opponent_id": f"{other}_team", "is_home": None, "points_for": f"{own}_points", "points_against": f"{other}_points"}
        names |= {c: f"{own}_{c}" for c in ("raw_attack", "raw_defence", "attack", "defence")}
        return F.struct(*[(F.col(c) if c else F.lit(home)).alias(name) for name, c in names.items()])

    rows = both.select("fixture_id", "match_date", "league_average", F.explode(F.array(side("home", "away", 1), side("away", "home", 0))).alias("x"))
    rows = rows.select("fixture_id", "match_date", "x.team_id", "x.opponent_id", "x.is_home", "x.points_for", "x.points_against", "league_average", "x.raw_attack", "x.raw_defence", "x.attack", "x.defence")
    scaled = {f"scaled_{c}": capped_curve(F.col(c), cap_start, max_edit, rate) for c in ("attack", "defence")}
    return resting_on(rows.withColumns(scaled), fixtures, raw, last)
