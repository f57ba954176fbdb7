"""Scoring factors by date, and expected scores of past and future fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["home_attack", "home_defence", "away_attack", "away_defence", "league_average", "home_factor", "away_factor"]


def daily_totals(results: DataFrame) -> DataFrame:
    """Matches and points of each date and of all dates up to it. One row a date, so one task may order them."""
    days = results.groupBy("match_date").agg(F.count("*").alias("n"), F.sum("home_score").alias("h"), F.sum("away_score").alias("a"))
    upto = Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("match_date", *[F.sum(c).over(upto).alias(c) for c in ("n", "h", "a")])


def _factors(totals: DataFrame) -> DataFrame:
    """League mean and side factors from cumulative totals n, h, a."""
    league = F.try_divide(F.col("h") + F.col("a"), F.col("n") * 2)
    return totals.withColumns({"league_average": league, "home_factor": F.try_divide(F.try_divide(F.col("h"), F.col("n")), league), "away_factor": F.try_divide(F.try_divide(F.col("a"), F.col("n")), league)})


def scoring_factors(results: DataFrame) -> DataFrame:
    """Factors of each date from strictly earlier dates; NULL on the first."""
    order = Window.orderBy("match_date")
    earlier = daily_totals(results).select("match_date", *[F.lag(c).over(order).alias(c) for c in ("n", "h", "a")])
    return _factors(earlier).select("match_date", "league_average", "home_factor", "away_factor")


def fixture_factors(results: DataFrame) -> DataFrame:
    """``fixture_id`` with the factors of its date."""
    return _with_factors(results.select("fixture_id", "match_date"), results)


def _with_factors(rows: DataFrame, results: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(scoring_factors(results)), "match_date", "left")  # one row a date


def fixture_strength(strength: DataFrame) -> DataFrame:
    """One row a fixture from its two team rows, where both are there: one grouping instead of a self join."""

    def side(home: int, c: str):
        return F.max(F.when(F.col("is_home") == home, F.col(c)))

    names = {"home_attack": (1, "scaled_attack"), "home_defence": (1, "scaled_defence"), "away_attack": (0, "scaled_attack"), "away_defence": (0, "scaled_defence")}
    rows = strength.groupBy("fixture_id", "match_date").agg(*[side(h, c).alias(n) for n, (h, c) in names.items()], F.count_if(F.col("is_home") == 1).alias("nh"), F.count_if(F.col("is_home") == 0).alias("na"))
    return rows.filter("nh = 1 AND na = 1").drop("nh", "na")


def with_scores(rows: DataFrame) -> DataFrame:
    home = F.col("league_average") * F.col("home_attack") * F.col("away_defence") * F.col("home_factor")
    away = F.col("league_average") * F.col("away_attack") * F.col("home_defence") * F.col("away_factor")
    return rows.withColumns({"expected_home": home, "expected_away": away}).withColumns({"expected_margin": F.col("expected_home") - F.col("expected_away"), "expected_total": F.col("expected_home") + F.col("expected_away")})


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose seven features are all present and positive; the others are for quarantine."""
    good = F.lit(True)
    for c in FEATURES:
        good = good & (F.coalesce(F.col(c), F.lit(0.0)) > 0)
    return rows.filter(good)


def expected_scores(strength: DataFrame, results: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Expected scores of played fixtures that have factors and multipliers, with the columns ``also`` of their results."""
    factors = _with_factors(results.select("fixture_id", "match_date", *also), results).dropna(subset=["league_average", "home_factor", "away_factor"]).drop("match_date")
    return with_scores(usable(fixture_strength(strength).join(factors, "fixture_id")))


def as_of_last(probes: DataFrame, builds: DataFrame, key: list[str], date: str, values: list[str], tie: str | None = None) -> DataFrame:
    """For each probe the values of the last build of its key strictly before its date.

    One shuffle: both are unioned, probes sort before builds of the same date, and
    the last build so far is carried forward.  Without a key, builds are one row a date.
    """
    held = F.struct(*[F.col(v) for v in values])
    left = probes.select("*", F.lit(0).alias("_side"), F.lit(None).cast(builds.select(held).schema[0].dataType).alias("_held"), F.lit(None).cast("string").alias("_tie"))
    plain = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (*key, date) else F.col(f.name) for f in probes.schema]
    right = builds.select(*plain, F.lit(1).alias("_side"), held.alias("_held"), (F.col(tie).cast("string") if tie else F.lit(None).cast("string")).alias("_tie"))
    order = Window.partitionBy(*key).orderBy(date, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumn("_last", F.last("_held", ignorenulls=True).over(order)).filter("_side = 0")
    return rows.select(*probes.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def factors_before(dates: DataFrame, results: DataFrame) -> DataFrame:
    """Factors from all results strictly before each of the distinct dates (one row a date)."""
    return _factors(as_of_last(dates.select("match_date").distinct(), daily_totals(results), [], "match_date", ["n", "h", "a"])).drop("n", "h", "a")


def predictions(fixtures: DataFrame, strength: DataFrame, results: DataFrame, prediction_date: str) -> DataFrame:
    """Expected scores of fixtures still to be played, from each side's latest strength before the match."""
    known = strength.filter("scaled_attack IS NOT NULL AND scaled_defence IS NOT NULL").select("team_id", "match_date", "fixture_id", F.col("scaled_attack").alias("attack"), F.col("scaled_defence").alias("defence"))
    rows = fixtures.select("fixture_id", "season", "match_date", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id")), F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id")))).alias("x"))
    sides = as_of_last(rows.select("fixture_id", "season", "match_date", "x.side", "x.team_id"), known, ["team_id"], "match_date", ["attack", "defence"], "fixture_id")
    wide = sides.groupBy("fixture_id", "season", "match_date").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in ("attack", "defence")])
    factors = factors_before(fixtures, results)  # one row a date
    return with_scores(usable(wide.join(F.broadcast(factors), "match_date"))).withColumn("prediction_date", F.lit(prediction_date).cast("date"))


def unplayed(fixtures: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Fixtures from ``as_of`` on without a result, or with one that lacks a score."""
    scored = results.dropna(subset=["home_score", "away_score"]).select("fixture_id")
    return fixtures.filter(F.col("match_date") >= F.lit(as_of).cast("date")).join(scored, "fixture_id", "left_anti")
