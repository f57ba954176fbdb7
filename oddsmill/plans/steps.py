"""Queries of the inner steps of the plans, each with its own DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oddsmill.functions import rating as fx
from oddsmill.operators import backtest, distributions, expected, form, integrity, keys, lineups, markets, residuals, season_log, strength, upsert
from oddsmill.plans import rebuild
from oddsmill.plans.catalog import _CURVE, _KEY, _MATCH, _swept, query, r, seasonal, sql, team_rows
from oddsmill.sources import tables
from oddsmill.sources import testdata as td
from oddsmill.sources.storage import shared_dir

# --- sources and integrity -----------------------------------------------------------------


@query("a4_parquet_load", "SELECT c_custkey AS player_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(c_name) END AS full_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def _(spark, sf):
    path = f"{shared_dir(spark)}/players-{uuid.uuid4().hex}"
    customers = td.table(spark, sf, "customer")
    customers.filter("c_custkey % 3 = 0").selectExpr("c_custkey player_id", "c_name full_name").write.parquet(path)
    known = customers.filter("c_custkey % 2 = 0").selectExpr("c_custkey player_id", "lower(c_name) full_name")
    return upsert.load_parquet(known, path, ["player_id"])


@query("a10_required", sql("SELECT 'columns' AS rule, 'results' AS key, 'venue' AS detail UNION ALL SELECT 'not_null(source_match_id)', CAST(row_idx AS VARCHAR), 'NULL' FROM season_log WHERE source_match_id IS NULL UNION ALL SELECT 'not_empty', 'results', '0' FROM results HAVING count(*) = 0", "season_log", "results"))
def _(spark, sf):
    results = td.results(spark, sf)
    return integrity.report(integrity.has_columns(results, ["fixture_id", "match_date", "venue"], "results"), integrity.not_empty(results, "results"), integrity.not_null(td.view(spark, sf, "season_log"), ["source_match_id"], ["row_idx"]))


@query("a11_first_table", "SELECT s_suppkey AS team_id, s_name AS team_name FROM supplier")
def _(spark, sf):
    # The first name does not exist, the second table lacks a column.
    found = tables.first_table(spark, [f"{sf}/{n}.parquet" for n in ("teams", "customer", "supplier")], ["s_suppkey", "s_name"])
    return tables.canonical(found, {"team_id": ["team_key", "s_suppkey"], "team_name": ["name", "s_name"]}).select("team_id", "team_name")


# --- ingestion -----------------------------------------------------------------------------


@query("b2_stages", sql("SELECT season, row_idx, st AS stage FROM heads WHERE n_cells <> 10", "heads"))
def _(spark, sf):
    return td.view(spark, sf, "season_log").filter("n_cells <> 10").select("season", "row_idx", fx.stage_of(F.col("heading")).alias("stage"))


@query("b3_dates", sql("SELECT season, row_idx, match_date FROM dated WHERE match_date IS NOT NULL", "dated"))
def _(spark, sf):
    return season_log.dated(season_log.staged(td.view(spark, sf, "season_log"))).select("season", "row_idx", "match_date")


@query("b4_whole_numbers", sql("SELECT row_idx, try_cast(replace(attendance_txt, ',', '') AS INT) AS attendance, try_cast(nullif(home_score_txt, '') AS INT) AS home_score FROM season_log", "season_log"))
def _(spark, sf):
    return td.view(spark, sf, "season_log").select("row_idx", fx.whole_number(F.col("attendance_txt")).alias("attendance"), fx.whole_number(F.col("home_score_txt")).alias("home_score"))


@query("b5_scored", sql("SELECT season, row_idx, home_score, away_score FROM kept", "kept"))
def _(spark, sf):
    rows = season_log.dated(season_log.staged(td.view(spark, sf, "season_log")))
    return season_log.scored(rows, 2023).select("season", "row_idx", "home_score", "away_score")


@query("b6_first_of_id", sql("SELECT season, row_idx, source_match_id FROM season_log QUALIFY source_match_id IS NULL OR row_number() OVER (PARTITION BY season, source_match_id ORDER BY row_idx) = 1", "season_log"))
def _(spark, sf):
    return season_log.first_of_id(td.view(spark, sf, "season_log")).select("season", "row_idx", "source_match_id")


@query("b7_texts_and_ids", "SELECT o_orderkey AS k, concat('Player ', o_custkey) AS name, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS match_number, concat('club-', o_custkey % 30) AS slug FROM orders")
def _(spark, sf):
    rows = td.table(spark, sf, "orders").selectExpr("o_orderkey k", "concat('  Player \\t', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN ' (C)' ELSE ' ' END) name", "concat(CASE WHEN o_orderkey % 2 = 0 THEN '/matches/' ELSE '/teams/' END, o_orderkey) href", "concat('/clubs/club-', o_custkey % 30, CASE WHEN o_orderkey % 5 = 0 THEN '/' ELSE '' END) club")
    return rows.select("k", fx.player_name(F.col("name")).alias("name"), fx.match_number(F.col("href")).alias("match_number"), fx.last_segment(F.col("club")).alias("slug"))


@query("b11_player_keys", sql(f"SELECT DISTINCT {_KEY} AS player_id, player_name FROM squad", "squad"))
def _(spark, sf):
    rows = lineups.lineups(td.view(spark, sf, "lineup_rows"))
    return rows.select(fx.player_key(F.col("source_player_id"), F.col("player_name")).alias("player_id"), "player_name").distinct()


def _lineup_fixtures(spark, sf):
    return td.view(spark, sf, "lineup_rows").select("match_id").distinct().selectExpr("match_id", "2020 + match_id % 5 season", "match_id % 20 home_team_id", "match_id % 20 + 1 away_team_id")


# --- keys ------------------------------------------------------------------------------------


@query("c2_canonical_names", "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'Leigh Leopards' WHEN 1 THEN 'Salford Red Devils' WHEN 2 THEN 'Wakefield Trinity' ELSE s_name END AS name FROM supplier")
def _(spark, sf):
    names = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'Leigh Centurions' WHEN 1 THEN 'Salford City Reds' WHEN 2 THEN 'Wakefield Trinity Wildcats' ELSE s_name END")
    return td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), keys.canonical_name(names).alias("name"))


_FIXTURE = "concat_ws('_', CAST(match_date AS VARCHAR), CAST(home_team_id AS VARCHAR), CAST(away_team_id AS VARCHAR))"


@query("c8_natural_keys", sql(f"SELECT source_match_id, {_FIXTURE} AS natural_key FROM matches", "matches"))
def _(spark, sf):
    return td.view(spark, sf, "matches").select("source_match_id", fx.fixture_key(F.col("match_date"), F.col("home_team_id"), F.col("away_team_id")).alias("natural_key"))


_FIRST = "(SELECT *, row_number() OVER (PARTITION BY match_date, home_team_id, away_team_id ORDER BY source_match_id) i FROM matches)"


def _source_matches(spark, sf):
    """Matches with every column that the source gives, not yet keyed."""
    given = {*tables.columns("fixtures"), *tables.columns("results")} - {"fixture_id", "source_match_id"}
    return td.view(spark, sf, "matches").selectExpr(*[f"{v} {c}" for c, v in _MATCH.items() if c in given], "source_match_id").withColumns({s: F.when(F.col("source_match_id") % 4 > 0, F.col(s)) for s in ("home_score", "away_score")})


def _projection(name: str) -> str:
    value = {**_MATCH, "fixture_id": _FIXTURE, "source_match_id": "source_match_id"}
    return f"SELECT {', '.join(f'{value[c]} AS {c}' for c in tables.columns(name))} FROM {_FIRST} WHERE i = 1" + (" AND source_match_id % 4 > 0" if name == "results" else "")


@query("c9_fixture_rows", sql(_projection("fixtures"), "matches"))
def _(spark, sf):
    return keys.fixture_rows(_source_matches(spark, sf))


@query("c9_result_rows", sql(_projection("results"), "matches"))
def _(spark, sf):
    return keys.result_rows(_source_matches(spark, sf))


@query("c13_appearances", sql("SELECT match_id, row_idx, side, team_id, season, player_id, lineup_order, is_starting FROM app", "app"))
def _(spark, sf):
    rows = lineups.appearances(lineups.lineups(td.view(spark, sf, "lineup_rows")), _lineup_fixtures(spark, sf))
    return rows.select("match_id", "row_idx", "side", "team_id", "season", "player_id", "lineup_order", "is_starting")


@query("c14_load_summary", sql("SELECT 2020 + match_id % 5 AS season, count(*) FILTER (s IS NOT NULL) AS retained, count(*) FILTER (s IS NULL) AS rejected, 0 AS unresolved, count(*) AS discovered FROM (SELECT DISTINCT l.match_id, q.match_id s FROM lineup_rows l LEFT JOIN squad q ON q.match_id = l.match_id) GROUP BY 1", "squad"))
def _(spark, sf):
    rows = td.view(spark, sf, "lineup_rows")
    good = lineups.lineups(rows).select("match_id").distinct().withColumn("status", F.lit("retained"))
    return lineups.load_summary(_lineup_fixtures(spark, sf).join(good, "match_id", "left").select("season", "match_id", F.coalesce("status", F.lit("rejected")).alias("status")))


# --- form and strength -------------------------------------------------------------------------


@query("d1_completed", sql("SELECT season, row_idx, home_score, away_score FROM logged WHERE home_score IS NOT NULL AND away_score IS NOT NULL", "logged"))
def _(spark, sf):
    rows = season_log.dated(season_log.staged(td.view(spark, sf, "season_log"))).withColumns({f"{s}_score": fx.whole_number(F.col(f"{s}_score_txt")) for s in ("home", "away")})
    return form.completed(rows).select("season", "row_idx", "home_score", "away_score")


@query("d4_form_build", sql(f"SELECT season, count(*) AS n, sum(games_used_5) AS games_5, sum(games_used_10) AS games_10, {r('avg(avg_for_5)', 'mean_5')}, {r('avg(avg_margin_10)', 'margin_10')} FROM form GROUP BY season", "form"))
def _(spark, sf):
    rows = form.recent_form(form.team_matches(td.results(spark, sf)))
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.sum("games_used_5").alias("games_5"), F.sum("games_used_10").alias("games_10"), F.avg("avg_for_5").alias("mean_5"), F.avg("avg_margin_10").alias("margin_10"))


def _raw(spark, sf):
    return strength.raw_multipliers(strength.league_average(form.recent_form(form.team_matches(td.results(spark, sf)), (5,))))


@query("e3_shrunk_form", sql(f"SELECT fixture_id, team_id, {r('ra * l', 'shrunk_for')}, {r('rd * l', 'shrunk_against')} FROM raw", "raw"))
def _(spark, sf):
    rows = strength.league_average(form.recent_form(form.team_matches(td.results(spark, sf)), (5,)))
    of = lambda c: fx.shrunk(F.col(f"avg_{c}_5"), F.col("games_used_5"), F.col("league_average"), 3)
    return rows.select("fixture_id", "team_id", of("for").alias("shrunk_for"), of("against").alias("shrunk_against"))


@query("e4_capped_curve", sql(f"SELECT fixture_id, team_id, {r(_CURVE.replace('x', 'ra'), 'attack', 9)}, {r(_CURVE.replace('x', 'rd'), 'defence', 9)} FROM raw", "raw"), digits=9)
def _(spark, sf):
    # Some values lie halfway between two roundings to six digits.
    return _raw(spark, sf).select("fixture_id", "team_id", *[fx.capped_curve(F.col(f"raw_{c}")).alias(c) for c in ("attack", "defence")])


@query("e7_adjusted_points", sql(f"SELECT s.fixture_id, s.team_id, {r('s.points_for / coalesce(o.d, 1.0)', 'adjusted_for')}, {r('s.points_against / coalesce(o.a, 1.0)', 'adjusted_against')} FROM st0 s LEFT JOIN st0 o ON o.fixture_id = s.fixture_id AND o.team_id = s.opponent_id", "st0"))
def _(spark, sf):
    rows = _raw(spark, sf).withColumns({"attack": F.col("raw_attack"), "defence": F.col("raw_defence")})
    return strength.adjusted(rows).select("fixture_id", "team_id", "adjusted_for", "adjusted_against")


# --- validation and features -------------------------------------------------------------------


@query("f1_results_rules", sql("SELECT 'not_null(home_score)' AS rule, fixture_id AS key, 'NULL' AS detail FROM results WHERE home_score = 7 UNION ALL SELECT 'points >= 0', fixture_id, '' FROM results WHERE away_score < 3", "results"))
def _(spark, sf):
    bad = td.results(spark, sf).withColumns({"home_score": F.nullif("home_score", F.lit(7)), "away_score": F.col("away_score") - 3})
    return integrity.report(*integrity.results_rules(bad))


@query("f4_with_factors", sql("SELECT fixture_id FROM results JOIN factors USING (match_date) WHERE league_average IS NOT NULL AND home_factor IS NOT NULL AND away_factor IS NOT NULL", "results", "factors"))
def _(spark, sf):
    return expected.fixture_factors(td.results(spark, sf)).dropna(subset=["league_average", "home_factor", "away_factor"]).select("fixture_id")


def _raw_sides(spark, sf):
    return expected.fixture_strength(_raw(spark, sf).withColumnsRenamed({"raw_attack": "scaled_attack", "raw_defence": "scaled_defence"}))


_SIDES = """SELECT fixture_id, match_date, max(CASE WHEN is_home = 1 THEN ra END) home_attack, max(CASE WHEN is_home = 1 THEN rd END) home_defence,
    max(CASE WHEN is_home = 0 THEN ra END) away_attack, max(CASE WHEN is_home = 0 THEN rd END) away_defence FROM raw GROUP BY ALL"""


@query("g1_fixture_strength", sql("SELECT fixture_id, " + ", ".join(r(c, c) for c in expected.FEATURES[:4]) + f" FROM ({_SIDES})", "raw"))
def _(spark, sf):
    return _raw_sides(spark, sf).select("fixture_id", *expected.FEATURES[:4])


@query("g2_with_factors", sql("SELECT DISTINCT fixture_id FROM raw JOIN factors USING (match_date) WHERE home_factor IS NOT NULL", "raw", "factors"))
def _(spark, sf):
    known = expected.fixture_factors(td.results(spark, sf)).dropna().select("fixture_id")
    return _raw_sides(spark, sf).join(known, "fixture_id", "left_semi").select("fixture_id")


_GOOD = " AND ".join(f"{c} > 0" for c in expected.FEATURES)


@query("g3_unusable", sql(f"SELECT fixture_id FROM ({_SIDES}) LEFT JOIN factors USING (match_date) WHERE NOT coalesce({_GOOD}, false)", "raw", "factors"))
def _(spark, sf):
    rows = _raw_sides(spark, sf).join(expected.fixture_factors(td.results(spark, sf)).drop("match_date"), "fixture_id")
    return rows.select("fixture_id").exceptAll(expected.usable(rows).select("fixture_id"))


@query("g4_features", sql("SELECT fixture_id, " + ", ".join(r(c, c) for c in expected.FEATURES) + f" FROM ({_SIDES}) JOIN factors USING (match_date) WHERE {_GOOD}", "raw", "factors"))
def _(spark, sf):
    factors = expected.fixture_factors(td.results(spark, sf)).drop("match_date")
    return expected.usable(_raw_sides(spark, sf).join(factors, "fixture_id")).select("fixture_id", *expected.FEATURES)


@query("g9_factors_before", sql(f"SELECT f.match_date, {r('league_average', 'league_average')}, {r('home_factor', 'home_factor')}, {r('away_factor', 'away_factor')} FROM (SELECT DISTINCT match_date FROM future) f ASOF LEFT JOIN fdays d ON f.match_date > d.match_date", "future", "fdays"))
def _(spark, sf):
    return expected.factors_before(td.future(spark, sf), td.results(spark, sf)).select("match_date", "league_average", "home_factor", "away_factor")


# --- distributions and markets -----------------------------------------------------------------

_AGE = "date_diff('day', match_date, DATE '2002-01-01') / 365.25::DOUBLE"


def _age():
    return fx.age_years(F.lit("2002-01-01").cast("date"), F.col("match_date"))


@query("h1_step_weights", sql(f"SELECT fixture_id, {r('CASE WHEN y <= 2 THEN 1 WHEN y <= 4 THEN 0.5 WHEN y <= 6 THEN 0.25 WHEN y <= 999 THEN 0.1 ELSE 0 END::DOUBLE', 'weight')} FROM (SELECT fixture_id, {_AGE} y FROM results)", "results"))
def _(spark, sf):
    return td.results(spark, sf).select("fixture_id", fx.step_weight(_age()).alias("weight"))


@query("h3_accepted_names", sql("SELECT fixture_id, match_date FROM results", "results"))
def _(spark, sf):
    rows = td.results(spark, sf).withColumnRenamed("match_date", "fixture_date")
    return tables.canonical(rows, {"match_date": ["match_date", "fixture_date"]}).select("fixture_id", "match_date")


@query("h8_history_rules", sql("SELECT 'not_null(home_score)' AS rule, fixture_id AS key, 'NULL' AS detail FROM results WHERE home_score = 7 UNION ALL SELECT 'scores >= 0', fixture_id, '' FROM results WHERE away_score < 3", "results"))
def _(spark, sf):
    bad = td.results(spark, sf).withColumns({"home_score": F.nullif("home_score", F.lit(7)), "away_score": F.col("away_score") - 3})
    return integrity.report(*integrity.history_rules(bad))


@query("h8_target_rules", sql("""SELECT 'not_null(expected_home)' AS rule, fixture_id AS key, 'NULL' AS detail FROM results WHERE home_score = 9 UNION ALL SELECT 'expected_away >= 0', fixture_id, CAST(away_score - 2 AS VARCHAR) FROM results WHERE away_score < 2
    UNION ALL SELECT '0 <= strength <= 1', '1.5', '' UNION ALL SELECT 'mean > 0', 'away_score', '0.0'""", "results"))
def _(spark, sf):
    rows = td.results(spark, sf)
    targets = rows.select("fixture_id", F.nullif("home_score", F.lit(9)).alias("expected_home"), (F.col("away_score") - 2).alias("expected_away"))
    return integrity.report(*integrity.target_rules(targets, ["expected_home", "expected_away"], ["fixture_id"], 1.5), integrity.mean_rules(rows.withColumn("away_score", F.lit(0))))


@query("h14_dense_grid", sql("SELECT h.k::INTEGER AS home_score, a.k::INTEGER AS away_score, coalesce(n, 0)::DOUBLE AS p FROM range(0, 61) h(k) CROSS JOIN range(0, 61) a(k) LEFT JOIN (SELECT home_score, away_score, count(*) n FROM results GROUP BY ALL) c ON c.home_score = h.k AND c.away_score = a.k", "results"))
def _(spark, sf):
    counts = td.results(spark, sf).groupBy("home_score", "away_score").agg(F.count("*").cast("double").alias("p"))
    return distributions.dense(counts, 60)


_PMF = "exp(-eh + k * ln(eh) - lgamma(k + 1))"


@query("h16_folded_poisson", sql(f"SELECT season, k::INTEGER AS k, {r(f'CASE WHEN k < 30 THEN {_PMF} ELSE 1 - sum(CASE WHEN k < 30 THEN {_PMF} ELSE 0 END) OVER (PARTITION BY season) END', 'p')} FROM means, range(0, 31) t(k)", "means"))
def _(spark, sf):
    means = distributions.implied_means(seasonal(spark, sf), ["season"])
    return distributions.poisson(means, "home_mean", 30, "fold").select("season", "k", "p")


@query("h17_decay_weights", sql(f"SELECT fixture_id, {r('CASE WHEN y <= 2 THEN 1 WHEN y <= 4 THEN 0.5 ELSE 0.5 * pow(0.5, (y - 4) / 2) END', 'weight')} FROM (SELECT fixture_id, {_AGE} y FROM results)", "results"))
def _(spark, sf):
    return td.results(spark, sf).select("fixture_id", fx.decay_weight(_age()).alias("weight"))


@query("i1_fair_prices", sql(f"SELECT season, home_score, away_score, {r('1 / p', 'decimal_price', 2)} FROM seasonal", "seasonal"))
def _(spark, sf):
    return seasonal(spark, sf).select("season", "home_score", "away_score", F.round(fx.price(F.col("p")), 2).alias("decimal_price"))


@query("i3_mainlines", sql("SELECT season, (floor(-(eh - ea)) + 0.5)::DOUBLE AS line FROM means", "means"))
def _(spark, sf):
    means = distributions.implied_means(seasonal(spark, sf), ["season"])
    return means.select("season", markets.handicap_mainline(F.col("home_mean"), F.col("away_mean")).cast("double").alias("line"))


@query("i4_one_line", sql(f"SELECT season, 'handicap' AS market, selection, -1.5::DOUBLE AS line, {r('probability', 'probability')} FROM (SELECT season, 'home' selection, sum(CASE WHEN home_score - away_score > 1.5 THEN p ELSE 0 END) probability FROM seasonal GROUP BY season UNION ALL SELECT season, 'away', 1 - sum(CASE WHEN home_score - away_score > 1.5 THEN p ELSE 0 END) FROM seasonal GROUP BY season)", "seasonal"))
def _(spark, sf):
    cells = seasonal(spark, sf)
    return markets.handicap_lines(markets.margins(cells, ["season"]), cells.select("season").distinct().withColumn("line", F.lit(-1.5)), ["season"]).drop("decimal_price")


# --- backtests and studies -----------------------------------------------------------------------


@query("k1_evaluation_set", sql(f"SELECT fixture_id, home_score, away_score, {r('expected_home', 'expected_home')} FROM fe WHERE season <> 1996 AND home_score >= 5", "fe"))
def _(spark, sf):
    rows = rebuild.expectations(spark, sf).withColumns({"home_score": F.when(F.col("season") == 1996, F.lit("none")).otherwise(F.col("home_score").cast("string")), "away_score": F.when(F.col("home_score") < 5, F.lit(-1)).otherwise(F.col("away_score"))})
    return backtest.evaluation_set(rows).select("fixture_id", "home_score", "away_score", "expected_home")


@query("k1_joined_evaluation", sql(f"SELECT fixture_id, season, match_date, h.s_name AS home_team, a.s_name AS away_team, home_score, away_score, {r('expected_home', 'expected_home')}, {r('expected_away', 'expected_away')} FROM fe JOIN supplier h ON h.s_suppkey = home_team_id JOIN supplier a ON a.s_suppkey = away_team_id WHERE h.s_suppkey % 9 > 0 AND a.s_suppkey % 9 > 0", "fe"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").filter("s_suppkey % 9 > 0").selectExpr("s_suppkey team_id", "s_name canonical_name")
    rows = backtest.joined_evaluation(td.results(spark, sf), rebuild.expectations(spark, sf), td.view(spark, sf, "matches"), teams)
    return backtest.evaluation_set(rows).drop("home_team_id", "away_team_id")


@query("k5_weight_sweep", sql(f"SELECT fixture_id, weight, {r('s', 'p_score')}, {r('h', 'p_home')}, {r('o', 'p_over')}, {r('c', 'p_cover')} FROM sw", "sw"))
def _(spark, sf):
    return _swept(spark, sf).select("fixture_id", "weight", "p_score", "p_home", "p_over", "p_cover")


@query("l1_team_residuals", sql(f"SELECT fixture_id, team_id, is_home, observed, {r('expected', 'expected')}, {r('residual', 'residual')} FROM res", "res"))
def _(spark, sf):
    return residuals.team_residuals(rebuild.expectations(spark, sf)).select("fixture_id", "team_id", "is_home", "observed", "expected", "residual")


_CAP = "(1 + sign(ra - 1) * 0.25 * (2 * least(abs(ra - 1) / 0.5, 1) - least(abs(ra - 1) / 0.5, 1) * least(abs(ra - 1) / 0.5, 1)))"


@query("l10_smooth_cap", sql(f"SELECT fixture_id, team_id, {r('ra', 'raw_attack')}, {r(_CAP, 'capped_attack')} FROM raw", "raw"))
def _(spark, sf):
    return _raw(spark, sf).select("fixture_id", "team_id", "raw_attack", fx.capped_curve(F.col("raw_attack"), 0.5, 0.25, 1.0).alias("capped_attack"))


_BY_CURVE = f"({_CURVE.replace('x', 'o.rd')}) / o.rd"


@query("m2_repriced", sql(f"SELECT s.fixture_id, s.team_id, {r(f'expected * (({_CURVE.replace('x', 's.ra')}) / s.ra) * ({_BY_CURVE})', 'predicted')} FROM res JOIN raw s USING (fixture_id, team_id) JOIN raw o ON o.fixture_id = s.fixture_id AND o.team_id = s.opponent_id WHERE s.ra > 0 AND o.rd > 0", "res", "raw"))
def _(spark, sf):
    # The table of strength has the raw multipliers of the same rows.
    raw = rebuild.converged(spark, sf).select("fixture_id", "is_home", F.col("raw_attack").alias("attack"), F.col("raw_defence").alias("defence"))
    fixtures = rebuild.expectations(spark, sf).drop(*[f"{s}_{c}" for s in ("home", "away") for c in ("attack", "defence")])
    rows = team_rows(residuals.with_multipliers(fixtures, raw)).filter("attack > 0 AND opponent_defence > 0")
    return residuals.repriced(rows).select("fixture_id", "team_id", "predicted")
