"""Season ratings: a Poisson model of tries with attack, defence and home effects.

The model is ``tries ~ home + team + opponent`` with a log link, one for every season of the
table at once.  Its likelihood equations say that expected and scored tries have equal sums
for each team, each opponent and the home side.  Iterative proportional fitting meets one
group of sums after the other: every attack is set so that the team's sum is met, then
every defence, then the home effect.

Matches are counted by pair first, so a pass reads one row a pair of teams and moves the
effects alone, which have one row a team and season.  Nothing depends on the number of
teams but rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.operators.distributions import log_factorials
from oddsmill.operators.form import team_matches
from oddsmill.sources.storage import discard, written

POINTS_PER_TRY = 5.2
KEY = ["season", "team"]


def tries(results: DataFrame, season: int | None = None, points_per_try: float = POINTS_PER_TRY) -> DataFrame:
    """Team rows with tries, of one season or of all."""
    rows = team_matches(results if season is None else results.filter(F.col("season") == season))
    return rows.select("fixture_id", F.col("season").cast("string").alias("season"), F.col("team_id").cast("string").alias("team"), F.col("opponent_id").cast("string").alias("opponent"), F.col("is_home").cast("double").alias("is_home"), (F.col("points_for") / points_per_try).alias("tries"))


def _attacks(pairs: DataFrame, defences: DataFrame) -> DataFrame:
    """``season, team, attack``: scored tries over the sum of what the team met; ``defences`` also has the season's ``home``."""
    met = pairs.join(defences.select("season", F.col("team").alias("opponent"), "defence", "home"), ["season", "opponent"])
    games = F.col("at_home") * F.col("home") + F.col("away")
    return met.groupBy(*KEY).agg(F.coalesce(F.try_divide(F.sum("tries"), F.sum(games * F.col("defence"))), F.lit(0.0)).alias("attack"))


def _swept(pairs: DataFrame, before: DataFrame, extrapolated: bool) -> DataFrame:
    """One sweep: attacks, then defences, then the home effect; ``moved`` is the greatest relative change of an effect in the row.

    Sweeps end up shrinking changes by a constant factor, which differs between groups of
    teams that do not meet.  If ``extrapolated``, each effect goes on by all the changes
    still to come at the factor of its last two.
    """
    met = pairs.join(_attacks(pairs, before), KEY)
    sums = met.groupBy("season", F.col("opponent").alias("team")).agg(
        F.sum("tries").alias("_c"), F.sum("home_tries").alias("_y"), F.sum(F.col("at_home") * F.col("attack")).alias("_h"), F.sum(F.col("away") * F.col("attack")).alias("_a"),
    )
    rows = sums.join(before.select(*KEY, F.col("defence").alias("_d"), F.col("home").alias("_home"), F.col("step").alias("_step"), F.col("home_step").alias("_home_step")), KEY)
    rows = rows.withColumn("defence", F.coalesce(F.try_divide(F.col("_c"), F.col("_home") * F.col("_h") + F.col("_a")), F.lit(0.0)))
    season = Window.partitionBy("season")  # one row a team
    step = lambda new, old: F.when((F.col(new) > 0) & (F.col(old) > 0), F.log(F.col(new) / F.col(old))).otherwise(0.0)
    home = F.try_divide(F.sum("_y").over(season), F.sum(F.col("defence") * F.col("_h")).over(season))
    rows = rows.withColumns({"step": step("defence", "_d"), "home": F.coalesce(home, F.lit(1.0))}).withColumn("home_step", step("home", "_home"))
    rows = rows.withColumn("moved", F.greatest(F.abs("step"), F.abs("home_step")))
    if extrapolated:
        for effect, now, last in (("defence", "step", "_step"), ("home", "home_step", "_home_step")):
            factor = F.greatest(F.least(F.coalesce(F.try_divide(F.col(now), F.col(last)), F.lit(0.0)), F.lit(0.9)), F.lit(0.0))
            rows = rows.withColumn(effect, F.col(effect) * F.exp(F.col(now) * factor / (1 - factor)))
    return rows.select(*KEY, "defence", "home", "step", "home_step", "moved")


def fit(rows: DataFrame, tolerance: float = 1e-8, most: int = 500) -> DataFrame:
    """``season, team, attack, defence, home``: expected tries are the product of a team's attack, the opponent's defence and, at home, ``home``.

    Team rows as ``tries`` gives them.  A team without a try has an attack of 0, one that
    concedes none a defence of 0, a season without home tries a home effect of 0 and one
    without home games an effect of 1; a team that never has the ball in the rows has no
    attack (NULL), one that never defends no defence.  Rows without season, team, opponent,
    venue or tries do not count.  The geometric mean of a season's positive defences is 1.
    """
    rows = rows.select("season", "team", "opponent", "is_home", "tries").dropna()
    at_home = F.col("is_home")
    pairs = written(rows.groupBy("season", "team", "opponent").agg(F.sum(at_home).alias("at_home"), F.sum(1 - at_home).alias("away"), F.sum("tries").alias("tries"), F.sum(F.col("tries") * at_home).alias("home_tries")), "rating-pairs")
    one = F.lit(1.0)
    state = written(pairs.select("season", F.col("opponent").alias("team")).distinct().withColumns({"defence": one, "home": one, "step": one, "home_step": one, "moved": one}), "ratings")
    for k in range(most):
        state = written(_swept(pairs, state, k % 3 == 2), "ratings", state)
        moved = state.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    else:
        raise ArithmeticError(f"ratings still move by {moved} after {most} passes")
    level = F.coalesce(F.exp(F.avg(F.when(F.col("defence") > 0, F.log("defence"))).over(Window.partitionBy("season"))), one)  # one row a team
    scaled = state.select(*KEY, (F.col("defence") / level).alias("defence"), "home", level.alias("_level"))
    homes = scaled.groupBy("season").agg(F.first("home").alias("home"), F.first("_level").alias("_level"))
    both = _attacks(pairs, state).join(scaled.select(*KEY, "defence"), KEY, "full").join(homes, "season")
    out = written(both.select(*KEY, (F.col("attack") * F.col("_level")).alias("attack"), "defence", "home"), "season-ratings")
    for done in (pairs, state):
        discard(done)
    return out


def coefficients(ratings: DataFrame) -> DataFrame:
    """``season, team, team_effect, opponent_effect, home_effect, intercept`` of the log link, the first team of a season as the baseline; NULL for the logarithm of 0."""
    log = lambda x: F.when(x > 0, F.log(x))
    base = ratings.groupBy("season").agg(F.min_by(F.struct("attack", "defence"), "team").alias("_b"))
    rows = ratings.join(base, "season")
    a, d = F.col("_b.attack"), F.col("_b.defence")
    return rows.select(*KEY, (log(F.col("attack")) - log(a)).alias("team_effect"), (log(F.col("defence")) - log(d)).alias("opponent_effect"), log(F.col("home")).alias("home_effect"), (log(a) + log(d)).alias("intercept"))


def unseen(ratings: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``fixture_id, season, team``: sides of fixtures (fixture_id, season, home_team, away_team) that their season's model does not know."""
    sides = fixtures.select("fixture_id", "season", F.explode(F.array("home_team", "away_team")).alias("team"))
    return sides.join(ratings.select(*KEY), KEY, "left_anti").select("fixture_id", "season", "team")


def expected_tries(ratings: DataFrame, fixtures: DataFrame, strict: bool = False) -> DataFrame:
    """Fixtures with ``expected_home_tries`` and ``expected_away_tries``; those with an unseen team go, or raise an error if ``strict``."""
    if strict:
        lost = unseen(ratings, fixtures).limit(10).collect()
        if lost:
            raise ValueError(f"teams without a rating: {[(r.fixture_id, r.team) for r in lost]}")
    side = lambda s: ratings.select("season", F.col("team").alias(f"{s}_team"), F.col("attack").alias(f"_{s}_attack"), F.col("defence").alias(f"_{s}_defence"), *([F.col("home").alias("_home")] if s == "home" else []))
    both = fixtures.join(side("home"), ["season", "home_team"]).join(side("away"), ["season", "away_team"])
    return both.select(*fixtures.columns, (F.col("_home") * F.col("_home_attack") * F.col("_away_defence")).alias("expected_home_tries"), (F.col("_away_attack") * F.col("_home_defence")).alias("expected_away_tries"))


def tries_chances(mean: Column, most: int = 16) -> Column:
    """Poisson chances of 0 to ``most`` tries as an array, not renormalised; NULL for a negative mean."""
    logs = F.array(*[F.lit(x) for x in log_factorials(most)])
    chances = F.transform(logs, lambda x, k: F.exp(k * F.log(mean) - mean - x))
    none = F.array(F.lit(1.0), *[F.lit(0.0)] * most)
    return F.when(mean > 0, chances).when(mean == 0, none)


def match_chances(means: DataFrame, keys: list[str], home: str, away: str, most: int = 16) -> DataFrame:
    """Home, draw and away chances from try means; cells beyond ``most`` are left out, then all three divided by their sum.

    Sides are independent, so the cells are never made: a side wins with the sum over its
    tries of their chance times the chance that the other side has fewer.
    """
    h, a = tries_chances(F.col(home), most), tries_chances(F.col(away), most)
    rows = means.select(*keys, h.alias("_h"), a.alias("_a"))

    def ahead(own: str, other: str) -> Column:
        start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("below"))
        pairs = F.arrays_zip(F.col(own).alias("x"), F.col(other).alias("y"))
        return F.aggregate(pairs, start, lambda s, v: F.struct((s["p"] + v["x"] * s["below"]).alias("p"), (s["below"] + v["y"]).alias("below")), lambda s: s["p"])

    level = F.aggregate(F.zip_with("_h", "_a", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    rows = rows.select(*keys, ahead("_h", "_a").alias("home"), level.alias("draw"), ahead("_a", "_h").alias("away"))
    total = F.col("home") + F.col("draw") + F.col("away")
    return rows.select(*keys, *[(F.col(n) / total).alias(n) for n in ("home", "draw", "away")])
