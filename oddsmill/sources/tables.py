"""Declared schemas of the fourteen tables, and typed readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAMPS = "created_at timestamp, updated_at timestamp"
_FACTORS = "league_average double, home_factor double, away_factor double, home_attack double, home_defence double, away_attack double, away_defence double, expected_home double, expected_away double"
_MULTIPLIERS = "league_average double, raw_attack double, raw_defence double, attack double, defence double, scaled_attack double, scaled_defence double"

SCHEMAS: dict[str, str] = {
    "tournaments": f"tournament_id long, name string, country string, type string, active int, {_STAMPS}",
    "tournament_source_mappings": f"source_name string, source_tournament_name string, tournament_id long, {_STAMPS}",
    "competition_stages": f"competition_stage_id long, tournament_id long, stage string, {_STAMPS}",
    "teams": f"team_id long, canonical_name string, current_tournament_id long, {_STAMPS}",
    "team_source_mappings": f"source_name string, source_team_name string, team_id long, valid_from int, valid_to int, {_STAMPS}",
    "fixtures": f"fixture_id string, season int, tournament_id long, competition_stage_id long, match_date date, kick_off string, home_team_id long, away_team_id long, referee string, venue string, source_name string, source_match_id string, {_STAMPS}",
    "results": f"fixture_id string, season int, match_date date, kick_off string, home_team_id long, home_score int, away_team_id long, away_score int, referee string, venue string, attendance int, source_name string, source_match_id string, {_STAMPS}",
    "players": f"player_id string, player_name string, season int, team_id long, primary_position string, active int, source_name string, source_player_id string, {_STAMPS}",
    "teamsheets": f"fixture_id string, season int, team_id long, player_id string, side string, position string, lineup_order int, is_starting int, source_name string, source_match_id string, source_url string, {_STAMPS}",
    "recent_form": "fixture_id string, team_id long, opponent_id long, season int, match_date date, is_home int, points_for int, points_against int, margin int, prior_games long, "
    + ", ".join(f"avg_{c}_{n} double" for n in (5, 10) for c in ("for", "against", "margin"))
    + f", games_used_5 long, games_used_10 long, {_STAMPS}",
    "strength_multipliers": f"fixture_id string, team_id long, opponent_id long, is_home int, match_date date, season int, {_MULTIPLIERS}, {_STAMPS}",
    "expected_scores": f"fixture_id string, match_date date, season int, home_team_id long, away_team_id long, {_FACTORS}, expected_margin double, expected_total double, {_STAMPS}",
    "expected_score_predictions": f"fixture_id string, prediction_date date, home_team_id long, away_team_id long, {_FACTORS}, {_STAMPS}",
    "historical_score_matrices": "matrix_version string, as_of_date date, home_score int, away_score int, p double",
}

#: Primary or unique keys of the tables that upserts go to.
KEYS: dict[str, list[str]] = {
    "tournament_source_mappings": ["source_name", "source_tournament_name"],
    "fixtures": ["fixture_id"],
    "results": ["fixture_id"],
    "players": ["player_id", "season", "team_id"],
    "teamsheets": ["fixture_id", "team_id", "player_id"],
    "expected_scores": ["fixture_id"],
    "expected_score_predictions": ["fixture_id"],
    "strength_multipliers": ["fixture_id", "team_id"],
    "recent_form": ["fixture_id", "team_id"],
}


def columns(name: str, stamps: bool = False) -> list[str]:
    """Column names of a table in declared order, without the time stamps unless asked."""
    names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return names if stamps else [c for c in names if c not in ("created_at", "updated_at")]


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the declared columns of a table in their order and types; what it lacks is NULL, other columns go.

    A value that its type does not hold is NULL and left to the integrity rules.
    """
    kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
    return df.select(*[(F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by its declared schema; only selected columns are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results from CSV: unnamed index columns go, rows with a missing required value go."""
    required = ["date", "home_team", "away_team", "home_score", "away_score"]
    raw = spark.read.option("header", True).csv(path)
    raw = raw.drop(*[c for c in raw.columns if c.startswith("Unnamed") or c.startswith("_c")])
    missing = [c for c in [*required, "year"] if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    rows = raw.dropna(subset=[*required, "year"])
    return rows.select(F.col("year").try_cast("int").alias("year"), F.to_date("date").alias("date"), "home_team", "away_team", *[F.col(c).try_cast("int").alias(c) for c in ("home_score", "away_score")])


def first_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of several accepted names that ``df`` has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} in {df.columns}")


def canonical(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Rename whichever accepted name occurs to the canonical one."""
    return df.withColumnsRenamed({first_column(df, accepted): name for name, accepted in names.items()})


def first_table(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The first of several Parquet tables that exists and has the columns."""
    for path in paths:
        try:
            found = spark.read.parquet(path)
        except AnalysisException:
            continue
        if set(columns) <= set(found.columns):
            return found
    raise ValueError(f"none of {paths} has {columns}")
