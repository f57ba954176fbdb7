"""Team rows of matches and their form before each match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (5, 10)


def completed(results: DataFrame) -> DataFrame:
    return results.dropna(subset=["home_score", "away_score"])


def team_matches(results: DataFrame) -> DataFrame:
    """Two rows a match, one for each team, in one pass."""

    def side(own: str, other: str, home: int):
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), F.lit(home).alias("is_home"),
            F.col(f"{own}_score").cast("int").alias("points_for"), F.col(f"{other}_score").cast("int").alias("points_against"),
        )

    rows = completed(results).select("fixture_id", "season", "match_date", F.explode(F.array(side("home", "away", 1), side("away", "home", 0))).alias("x"))
    return rows.select("fixture_id", "season", "match_date", "x.*").withColumn("margin", F.col("points_for") - F.col("points_against"))


def recent_form(rows: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Means of the games before each one, over the last n of the team; all windows share one sort."""
    if not windows or min(windows) <= 0:
        raise ValueError("windows must be positive")
    order = Window.partitionBy("team_id").orderBy("match_date", "fixture_id")
    out = {"prior_games": (F.row_number().over(order) - 1).cast("long")}
    for n in windows:
        before = order.rowsBetween(-n, -1)
        for name, c in (("for", "points_for"), ("against", "points_against"), ("margin", "margin")):
            out[f"avg_{name}_{n}"] = F.avg(c).over(before)
        out[f"games_used_{n}"] = F.count("points_for").over(before)
    return rows.withColumns(out)
