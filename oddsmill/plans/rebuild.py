"""End-to-end plans: from results to strength, predictions and fair prices of all fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.operators import distributions, expected, form, integrity, markets, strength, upsert
from oddsmill.sources import tables
from oddsmill.sources import testdata as td
from oddsmill.sources.storage import kept, written

MAX_SCORE = 100


def features(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strength of every team before every match, and expected scores of played fixtures."""
    made = strength.strength(form.team_matches(results))
    power = written(made, "strength", made)
    return power, expected.expected_scores(power, results)


def strength_table(results: DataFrame, known: DataFrame | None = None, **parameters) -> DataFrame:
    """Rows of the table of multipliers after a build: those of ``known`` for the same fixture and team are replaced."""
    made = strength.strength(form.team_matches(results), **parameters).join(results.select("fixture_id", "season"), "fixture_id")
    return _rows("strength_multipliers", made, known)


def expected_table(results: DataFrame, power: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of the table of expected scores after a build from strength; fixtures of ``known`` are replaced."""
    return _rows("expected_scores", expected.expected_scores(power, results).join(results.select("fixture_id", "season", "home_team_id", "away_team_id"), "fixture_id"), known)


def _rows(name: str, made: DataFrame, known: DataFrame | None) -> DataFrame:
    rows = tables.conformed(made, name)
    integrity.report(integrity.unique(rows, tables.KEYS[name]), strict=True)
    return rows if known is None else upsert.upsert(tables.conformed(known, name), rows.withColumn("_n", F.lit(1)), tables.KEYS[name], "_n")


def _of_matches(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of the played matches, written once an application while their files stay as they are."""
    return kept(f"{name}|{strength.PASSES}|{strength.TOLERANCE}", [td.table(spark, sf_dir, t) for t in ("orders", "lineitem")], make)


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played matches, taken from the tables once."""
    return _of_matches(spark, sf_dir, "played", lambda: td.results(spark, sf_dir))


def converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of every team before every match, iterated to the fixpoint."""
    return _of_matches(spark, sf_dir, "strength", lambda: strength.strength(form.team_matches(played(spark, sf_dir))))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played fixtures with teams, scores, factors, scaled multipliers and expected scores."""

    def make() -> DataFrame:
        return expected.expected_scores(converged(spark, sf_dir), played(spark, sf_dir), ("season", "home_team_id", "home_score", "away_team_id", "away_score"))

    return _of_matches(spark, sf_dir, "expectations", make)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = played(spark, sf_dir)
    integrity.report(*integrity.results_rules(results), strict=True)
    return expected.predictions(td.future(spark, sf_dir), converged(spark, sf_dir), results, td.AS_OF)


def priced(fixtures: DataFrame, base: DataFrame, max_score: int = MAX_SCORE) -> DataFrame:
    """Match odds and both ladders of fixtures (fixture_id, expected_home, expected_away) from a base matrix."""
    tilted = distributions.tilts(base, fixtures.select("fixture_id", "expected_home", "expected_away"), "expected_home", "expected_away", max_score)
    pmfs = distributions.margin_and_total(base, tilted, max_score)
    return markets.ladders_of_arrays(pmfs, ["fixture_id"], "expected_home", "expected_away", max_score)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair prices of every fixture still to be played."""
    base = distributions.historical(played(spark, sf_dir), td.AS_OF)
    return priced(predictions(spark, sf_dir), base)
