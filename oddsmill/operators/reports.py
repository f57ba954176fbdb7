"""Inspection and serving queries over expected scores and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.operators.selection import percentiles
from oddsmill.sources.storage import written

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")


def describe(df: DataFrame, columns: list[str], shares: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """A row a column. The columns are written once, as each percentile range reads them again."""
    rows = written(df.select(*columns), "described")
    marks = [(c, *percentiles(rows, c, list(shares))) for c in columns]
    table = df.sparkSession.createDataFrame(marks, "name string, " + ", ".join(f"p{round(q * 100)} double" for q in shares))
    stats = _long(rows, columns).groupBy("name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("x") <= 0).alias("not_positive"),
    )
    return stats.join(F.broadcast(table), "name")


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Equal bins between the extremes of each column; the last one is closed on the right."""
    long = _long(df, columns).dropna()
    ends = long.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row a column
    bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins))
    return long.join(F.broadcast(ends), "name").groupBy("name", F.coalesce(bin_, F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    top = df.orderBy(F.col(column).desc(), key).limit(n).withColumn("end", F.lit("high"))
    low = df.orderBy(F.col(column), key).limit(n).withColumn("end", F.lit("low"))
    return top.unionByName(low)


def named(df: DataFrame, teams: DataFrame, name: str) -> DataFrame:
    """Add home and away team names."""
    h = teams.select(F.col("team_id").alias("home_team_id"), F.col(name).alias("home_name"))
    a = teams.select(F.col("team_id").alias("away_team_id"), F.col(name).alias("away_name"))
    return df.join(h, "home_team_id", "left").join(a, "away_team_id", "left")


def team_points(df: DataFrame) -> DataFrame:
    """Points of each team over home and away."""
    rows = df.select(F.explode(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("expected_home").alias("x")), F.struct(F.col("away_team_id").alias("team_id"), F.col("expected_away").alias("x")))).alias("v")).select("v.*")
    return rows.groupBy("team_id").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.max("x").alias("most"))


def errors(df: DataFrame) -> DataFrame:
    h, a = F.col("home_score") - F.col("expected_home"), F.col("away_score") - F.col("expected_away")
    return df.agg(*[f(e).alias(f"{n}_{k}") for n, e in (("home", h), ("away", a), ("margin", h - a), ("total", h + a)) for k, f in (("error", F.avg), ("mae", lambda e: F.avg(F.abs(e))))])


def last_results(fixtures: DataFrame, team_rows: DataFrame, n: int = 3) -> DataFrame:
    """For both teams of each fixture, their last n games strictly before it.

    Each team's games are numbered once; a fixture then needs the numbers just below
    its own place, which an as-of count gives: an equi join on (team, number), not a range join.
    """
    sides = fixtures.select("fixture_id", "match_date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    order = Window.partitionBy("team_id").orderBy("match_date", "fixture_id")
    games = team_rows.withColumn("no", F.row_number().over(order))
    marks = sides.select("team_id", "match_date", "fixture_id", F.lit(0).alias("game")).unionByName(team_rows.select("team_id", "match_date", F.col("fixture_id"), F.lit(1).alias("game")))
    upto = Window.partitionBy("team_id").orderBy("match_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_day = Window.partitionBy("team_id", "match_date")
    before = F.sum("game").over(upto) - F.sum("game").over(same_day)
    asked = marks.withColumn("before", before).filter("game = 0").select("team_id", F.col("fixture_id").alias("for_fixture"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("back"), "before")
    asked = asked.withColumn("no", (F.col("before") - F.col("back") + 1).cast("int")).filter("no >= 1")
    place = F.when(F.col("is_home") == 1, "H").otherwise("A")
    return asked.join(games, ["team_id", "no"]).select("for_fixture", "team_id", "back", "fixture_id", "opponent_id", "points_for", "points_against", place.alias("place"))


def by_day(fixtures: DataFrame) -> DataFrame:
    """Fixture ids of each day in order; a day's fixtures are few."""
    return fixtures.groupBy("match_date").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("fixture_id")), ",").alias("fixtures"))


def largest_misses(df: DataFrame, n: int = 5) -> DataFrame:
    """The fixtures whose total and whose margin were missed most."""
    h, a = F.col("home_score") - F.col("expected_home"), F.col("away_score") - F.col("expected_away")
    rows = df.select("fixture_id", (h + a).alias("total_error"), (h - a).alias("margin_error"))
    parts = [rows.orderBy(F.abs(c).desc(), "fixture_id").limit(n).withColumn("by", F.lit(c)) for c in ("total_error", "margin_error")]
    return parts[0].unionByName(parts[1])


def details(ids: DataFrame, fixtures: DataFrame, teams: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The asked fixtures with team names, and the asked ids that do not exist."""
    asked = ids.select("fixture_id").distinct()
    found = named(fixtures.join(asked, "fixture_id", "left_semi"), teams, name)
    return found, asked.join(fixtures.select("fixture_id"), "fixture_id", "left_anti")
