"""Match programmes to lineups, players and appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import player_key, player_name

STARTERS, SQUAD = 13, 17


def ordered(rows: DataFrame) -> DataFrame:
    """One row a listed player: from the first full back to the next head coach, in a running order that both sides share."""
    w = Window.partitionBy("match_id").orderBy("row_idx")
    started = F.max((F.col("position") == "FB").cast("int")).over(w) == 1
    rows = rows.withColumn("_started", started)
    ended = F.sum((F.col("_started") & (F.col("position") == "HC")).cast("int")).over(w) > 0
    named = F.col("home_name").isNotNull() | F.col("away_name").isNotNull()
    rows = rows.withColumn("_ended", ended).filter(F.col("_started") & ~F.col("_ended") & named)
    rows = rows.withColumn("lineup_order", F.row_number().over(w))
    sides = F.array(F.struct(F.lit("home").alias("side"), F.col("home_name").alias("name")), F.struct(F.lit("away").alias("side"), F.col("away_name").alias("name")))
    out = rows.select("match_id", "row_idx", "position", "lineup_order", "source_player_id", F.explode(sides).alias("x")).filter("x.name IS NOT NULL")
    return out.select("match_id", "row_idx", "x.side", player_name(F.col("x.name")).alias("player_name"), "source_player_id", "position", "lineup_order", (F.col("lineup_order") <= STARTERS).cast("int").alias("is_starting"))


def judged(players: DataFrame) -> DataFrame:
    """Add ``nth`` within the side and ``valid``: both sides have enough players."""
    side = Window.partitionBy("match_id", "side").orderBy("lineup_order")
    counted = players.withColumns({"nth": F.row_number().over(side)})
    whole = Window.partitionBy("match_id")
    home, away = (F.count_if(F.col("side") == s).over(whole) for s in ("home", "away"))
    return counted.withColumn("valid", (home >= STARTERS) & (away >= STARTERS))


def lineups(rows: DataFrame) -> DataFrame:
    return judged(ordered(rows)).filter(F.col("valid") & (F.col("nth") <= SQUAD)).drop("nth", "valid")


def rejected(rows: DataFrame) -> DataFrame:
    """Matches without a start row or with a short side."""
    ids = rows.select("match_id").distinct()
    return ids.join(lineups(rows).select("match_id").distinct(), "match_id", "left_anti")


def appearances(players: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Lineup rows with the player's key and the team of the side; fixtures: match_id, season, home_team_id, away_team_id."""
    team = F.when(F.col("side") == "home", F.col("home_team_id")).otherwise(F.col("away_team_id"))
    key = player_key(F.col("source_player_id"), F.col("player_name"))
    return players.join(fixtures, "match_id").select("match_id", "season", team.alias("team_id"), key.alias("player_id"), "player_name", "source_player_id", "side", "position", "lineup_order", "is_starting", "row_idx")


def squads(rows: DataFrame) -> DataFrame:
    """One row a player, season and team: first name seen, most frequent position (ties to the first seen)."""
    key = ["player_id", "season", "team_id"]
    names = rows.groupBy(*key).agg(F.min_by("player_name", F.struct("match_id", "row_idx")).alias("player_name"), F.count("*").alias("appearances"))
    filled = rows.filter(F.trim(F.coalesce("position", F.lit(""))) != "")
    counts = filled.groupBy(*key, "position").agg(F.count("*").alias("n"), F.min(F.struct("match_id", "row_idx")).alias("first"))
    best = counts.groupBy(*key).agg(F.min_by("position", F.struct(-F.col("n"), F.col("first"))).alias("primary_position"))
    return names.join(best, key, "left")


def load_summary(status: DataFrame) -> DataFrame:
    """Matches of each season by status (season, match_id, status)."""
    return status.groupBy("season").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("retained", "rejected", "unresolved")], F.countDistinct("match_id").alias("discovered"))
