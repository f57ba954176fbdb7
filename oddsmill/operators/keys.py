"""Resolving source names to keys, and keeping the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import fixture_key
from oddsmill.sources.tables import columns

#: Source names that stand for an existing club.
ALIASES = {"Leigh Centurions": "Leigh Leopards", "Salford City Reds": "Salford Red Devils", "Wakefield Trinity Wildcats": "Wakefield Trinity"}


def canonical_name(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)


def valid_mapping(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Rows (source_team_name, season, ...) with the team that the name meant in the season.

    Of several valid mappings the one with the newest ``valid_from`` counts, an open one last.
    Names and seasons are resolved once for each distinct pair.
    """
    asked = rows.select("source_team_name", "season").distinct()
    m = mappings.alias("m")
    fits = (F.col("m.valid_from").isNull() | (F.col("m.valid_from") <= F.col("season"))) & (F.col("m.valid_to").isNull() | (F.col("m.valid_to") >= F.col("season")))
    found = asked.join(m, "source_team_name").filter(fits)
    newest = F.max_by("team_id", F.struct(F.coalesce("valid_from", F.lit(-1)), F.col("team_id")))
    return rows.join(found.groupBy("source_team_name", "season").agg(newest.alias("team_id")), ["source_team_name", "season"], "left")


def new_keys(dim: DataFrame, names: DataFrame, key: str, name: str, seen: list[str]) -> DataFrame:
    """``key, name, valid_from`` for names that ``dim`` lacks, numbered in the order of first appearance."""
    fresh = names.join(dim.select(name), name, "left_anti").groupBy(name).agg(F.min(F.struct(*seen)).alias("first"))
    top = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))  # one row
    nth = F.row_number().over(Window.orderBy("first", name))  # new names only
    return fresh.crossJoin(F.broadcast(top)).select((F.col("top") + nth).cast("long").alias(key), name, F.col(f"first.{seen[0]}").alias("valid_from"))


def one_tournament(rows: DataFrame) -> DataFrame:
    """Seasons whose batch does not have exactly one tournament."""
    return rows.groupBy("season").agg(F.countDistinct("tournament").alias("n")).filter("n <> 1")


def current_tournaments(fixtures: DataFrame) -> DataFrame:
    """The tournament of each team's latest season."""
    sides = fixtures.select("season", "tournament_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return sides.groupBy("team_id").agg(F.max_by("tournament_id", F.struct("season", "tournament_id")).alias("tournament_id"))


def fixture_of(matches: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Fixture ids by source id, else by (season, teams, date) where just one fixture fits."""
    by_id = fixtures.filter("source_match_id IS NOT NULL").groupBy("season", "source_match_id").agg(F.min("fixture_id").alias("by_id"))
    natural = ["season", "home_team_id", "away_team_id", "match_date"]
    by_key = fixtures.groupBy(*natural).agg(F.min("fixture_id").alias("by_key"), F.count("*").alias("n")).filter("n = 1").drop("n")
    both = matches.join(by_id, ["season", "source_match_id"], "left").join(by_key, natural, "left")
    return both.withColumn("fixture_id", F.coalesce("by_id", "by_key")).drop("by_id", "by_key")


def pending(found: DataFrame, fixtures: DataFrame, loaded: DataFrame) -> DataFrame:
    """Source matches of known fixtures that are not loaded yet."""
    return found.join(fixtures.select("source_match_id"), "source_match_id", "left_semi").join(loaded.select("source_match_id"), "source_match_id", "left_anti")


def with_team_ids(matches: DataFrame, mappings: DataFrame) -> DataFrame:
    """Matches (home_name, away_name, season, ...) with both team ids; unmapped names stay NULL for the integrity rules."""
    out = matches
    for side in ("home", "away"):
        name = f"{side}_name"
        asked = out.select(F.col(name).alias("source_team_name"), "season").distinct()
        found = valid_mapping(asked, mappings).select(F.col("source_team_name").alias(name), "season", F.col("team_id").alias(f"{side}_team_id"))
        out = out.join(found, [name, "season"], "left")
    return out


def stages(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``competition_stage_id, tournament_id, stage`` after the load: known stages and numbered new ones; blank is no stage."""
    named = rows.select("tournament_id", F.nullif(F.trim("stage"), F.lit("")).alias("stage"), "season").dropna(subset=["stage"])
    fresh = named.groupBy("tournament_id", "stage").agg(F.min("season").alias("season")).join(known.select("tournament_id", "stage"), ["tournament_id", "stage"], "left_anti")
    top = known.agg(F.coalesce(F.max("competition_stage_id"), F.lit(0)).alias("top"))  # one row
    nth = F.row_number().over(Window.orderBy("season", "tournament_id", "stage"))  # new stages only
    new = fresh.crossJoin(F.broadcast(top)).select((F.col("top") + nth).cast("long").alias("competition_stage_id"), "tournament_id", "stage")
    return known.select("competition_stage_id", "tournament_id", "stage").unionByName(new)


def _keyed(matches: DataFrame) -> DataFrame:
    """Matches with their natural key as fixture id; of several with one key the least source id counts."""
    rows = matches.withColumn("fixture_id", fixture_key(F.col("match_date"), F.col("home_team_id"), F.col("away_team_id")))
    return rows.groupBy("fixture_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "fixture_id"]), "source_match_id").alias("m")).select("fixture_id", "m.*")


def fixture_rows(matches: DataFrame) -> DataFrame:
    """All matches as rows of the table of fixtures: scores are left out."""
    return _keyed(matches).select(*columns("fixtures"))


def result_rows(matches: DataFrame) -> DataFrame:
    """Played matches as rows of the table of results."""
    return _keyed(matches).dropna(subset=["home_score", "away_score"]).select(*columns("results"))
