"""Queries over the head-to-head views of the synthetic tables, and the same in DuckDB SQL.

Doubles are rounded on both sides, as the engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from oddsmill.functions import rating as fx
from oddsmill.operators import backtest, distributions, expected, form, integrity, keys, lineups, markets, ratings, reports, residuals, season_log, strength, upsert
from oddsmill.plans import rebuild, staged
from oddsmill.sources import tables
from oddsmill.sources import testdata as td
from oddsmill.sources.storage import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6

CTES: dict[str, str] = {name: td.duckdb_view(name) for name in td.VIEWS}
CTES |= {
    "results": f"SELECT * FROM matches WHERE NOT (status = 'O' AND match_date >= DATE '{td.AS_OF}')",
    "future": f"SELECT * FROM matches WHERE status = 'O' AND match_date >= DATE '{td.AS_OF}'",
    "tm": """SELECT fixture_id, season, match_date, home_team_id team_id, away_team_id opponent_id, 1 is_home, home_score points_for, away_score points_against, home_score - away_score margin FROM results
        UNION ALL SELECT fixture_id, season, match_date, away_team_id, home_team_id, 0, away_score, home_score, away_score - home_score FROM results""",
    "form": """SELECT *, row_number() OVER o - 1 prior_games,
          avg(points_for) OVER w5 avg_for_5, avg(points_against) OVER w5 avg_against_5, avg(margin) OVER w5 avg_margin_5, count(points_for) OVER w5 games_used_5,
          avg(points_for) OVER w10 avg_for_10, avg(points_against) OVER w10 avg_against_10, avg(margin) OVER w10 avg_margin_10, count(points_for) OVER w10 games_used_10
        FROM tm WINDOW o AS (PARTITION BY team_id ORDER BY match_date, fixture_id),
          w5 AS (PARTITION BY team_id ORDER BY match_date, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
          w10 AS (PARTITION BY team_id ORDER BY match_date, fixture_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    "league": """SELECT fixture_id, avg(p) OVER (ORDER BY match_date, fixture_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) league_average
        FROM (SELECT fixture_id, match_date, avg(points_for) p FROM tm GROUP BY ALL)""",
    "raw": """SELECT f.fixture_id, f.match_date, f.team_id, f.opponent_id, f.is_home, points_for, points_against, league_average l,
          ((coalesce(avg_for_5, league_average) * games_used_5 + league_average * 3) / (games_used_5 + 3)) / league_average ra,
          ((coalesce(avg_against_5, league_average) * games_used_5 + league_average * 3) / (games_used_5 + 3)) / league_average rd
        FROM form f JOIN league USING (fixture_id)""",
    "st0": "SELECT *, ra a, rd d FROM raw",
}
for _k in range(10):
    CTES[f"st{_k + 1}"] = f"""SELECT fixture_id, match_date, team_id, opponent_id, is_home, points_for, points_against, l, ra, rd,
          ((coalesce(f, l) * g + l * 3) / (g + 3)) / l a, ((coalesce(q, l) * g + l * 3) / (g + 3)) / l d
        FROM (SELECT *, avg(pf) OVER w f, avg(pa) OVER w q, count(pf) OVER w g FROM (
          SELECT s.*, s.points_for / coalesce(o.d, 1.0) pf, s.points_against / coalesce(o.a, 1.0) pa
          FROM st{_k} s LEFT JOIN st{_k} o ON o.fixture_id = s.fixture_id AND o.team_id = s.opponent_id)
        WINDOW w AS (PARTITION BY team_id ORDER BY match_date, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
_CURVE = "1 + sign((x - 1) * 0.8) * 0.4 * (2 * least(abs((x - 1) * 0.8) / 0.75, 1) - least(abs((x - 1) * 0.8) / 0.75, 1) * least(abs((x - 1) * 0.8) / 0.75, 1))"
_EH, _EA = "league_average * ha * ad * home_factor", "league_average * aa * hd * away_factor"
CTES |= {
    "strength": f"SELECT *, {_CURVE.replace('x', 'a')} sa, {_CURVE.replace('x', 'd')} sd FROM st10",
    "days": "SELECT match_date, sum(count(*)) OVER w n, sum(sum(home_score)) OVER w h, sum(sum(away_score)) OVER w a FROM results GROUP BY match_date WINDOW w AS (ORDER BY match_date)",
    "factors": """SELECT match_date, (h + a) / (2 * n) league_average, (h / n) / ((h + a) / (2 * n)) home_factor, (a / n) / ((h + a) / (2 * n)) away_factor
        FROM (SELECT match_date, lag(n) OVER o n, lag(h) OVER o h, lag(a) OVER o a FROM days WINDOW o AS (ORDER BY match_date))""",
    "sides": """SELECT fixture_id, match_date, max(CASE WHEN is_home = 1 THEN sa END) ha, max(CASE WHEN is_home = 1 THEN sd END) hd,
        max(CASE WHEN is_home = 0 THEN sa END) aa, max(CASE WHEN is_home = 0 THEN sd END) ad FROM strength GROUP BY ALL""",
    # Played fixtures with the expected scores of the fixpoint, for the reports and studies.
    "fe": f"""SELECT r.fixture_id, season, r.match_date, home_team_id, away_team_id, home_score, away_score, {_EH} expected_home, {_EA} expected_away, ha home_attack, hd home_defence, aa away_attack, ad away_defence
        FROM results r JOIN sides USING (fixture_id) JOIN factors f ON f.match_date = r.match_date
        WHERE ha > 0 AND hd > 0 AND aa > 0 AND ad > 0 AND league_average > 0 AND home_factor > 0 AND away_factor > 0""",
    "res": """SELECT fixture_id, match_date, team_id, is_home, observed, expected, observed - expected residual FROM (
          SELECT fixture_id, match_date, home_team_id team_id, 1 is_home, CAST(home_score AS DOUBLE) observed, expected_home expected FROM fe
          UNION ALL SELECT fixture_id, match_date, away_team_id, 0, CAST(away_score AS DOUBLE), expected_away FROM fe)""",
    "flag": """SELECT *, NOT (residual BETWEEN mu - 1.5 * sd AND mu + 1.5 * sd) outlier FROM res,
          (SELECT avg(residual) mu, stddev_samp(residual) sd, quantile_cont(residual, 0.05) q05, quantile_cont(residual, 0.95) q95 FROM res)""",
    "seasonal": """SELECT season, home_score, away_score, w / sum(w) OVER (PARTITION BY season) p FROM (SELECT season, home_score, away_score, sum(w) w FROM (
          SELECT *, CASE WHEN y <= 2 THEN 1.0 WHEN y <= 4 THEN 0.5 WHEN y <= 6 THEN 0.25 WHEN y <= 999 THEN 0.1 ELSE 0 END::DOUBLE w
          FROM (SELECT *, date_diff('day', match_date, DATE '2000-01-01') / 365.25::DOUBLE y FROM results)) GROUP BY ALL)""",
    "means": "SELECT season, sum(home_score * p) eh, sum(away_score * p) ea FROM seasonal GROUP BY season",
}
_TD_BASE = {"results": ["matches"], "future": ["matches"], "tm": ["results"], "form": ["tm"], "league": ["tm"], "raw": ["form", "league"], "st0": ["raw"], "strength": ["st10"], "days": ["results"], "factors": ["days"], "sides": ["strength"], "fe": ["results", "sides", "factors"], "res": ["fe"], "flag": ["res"], "seasonal": ["results"], "means": ["seasonal"]}
_TD_BASE |= {f"st{k + 1}": [f"st{k}"] for k in range(10)}


def sql(body: str, *names: str) -> str:
    """``body`` with the common table expressions that it names, and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _TD_BASE.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + body


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    doubles = {f.name: F.round(f.name, digits) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, DoubleType)}
    return df.withColumns(doubles) if doubles else df


def r(expression: str, name: str, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def query(name: str, oracle: str | None = None, digits: int = DIGITS):
    def added(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return added


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.historical(td.results(spark, sf_dir), "2000-01-01", ["season"])


# --- sources, sinks, integrity -------------------------------------------------------------


@query("a2_results_scan", sql("SELECT fixture_id, season, match_date, home_team_id, away_team_id, home_score, away_score FROM results", "results"))
def _(spark, sf):
    return td.results(spark, sf).select("fixture_id", "season", "match_date", "home_team_id", "away_team_id", "home_score", "away_score")


@query("a3_csv_results", "SELECT year(o_orderdate) AS year, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS home_team, o_orderpriority AS away_team, CAST(o_orderkey % 50 AS INTEGER) AS home_score, CAST(o_custkey % 50 AS INTEGER) AS away_score FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, sf):
    from oddsmill.sources.tables import read_results_csv

    rows = td.table(spark, sf, "orders").selectExpr("o_orderkey AS `Unnamed: 0`", "year(o_orderdate) year", "cast(o_orderdate as date) date", "o_custkey home_team", "o_orderpriority away_team", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END home_score", "o_custkey % 50 away_score")
    path = f"{shared_dir(spark)}/results-csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return read_results_csv(spark, path)


@query("a5_upsert", sql("SELECT coalesce(t.k, b.k) AS k, coalesce(b.v, t.v) AS v FROM (SELECT o_orderkey k, o_totalprice v FROM orders WHERE o_orderkey % 2 = 0) t FULL JOIN (SELECT k, arg_max(v, batch_seq) v FROM upsert_batch GROUP BY k) b USING (k)", "upsert_batch"))
def _(spark, sf):
    target = td.table(spark, sf, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_orderkey k", "o_totalprice v")
    return upsert.upsert(target, td.view(spark, sf, "upsert_batch"), ["k"], "batch_seq")


@query("a6_missing_values", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE round(value, 6) + 0.0 END AS value, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, sf):
    rows = td.table(spark, sf, "events").withColumn("value", F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rows.select("event_id", fx.missing(F.col("value")).alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


#: Every column of the tables that upserts go to, as SQL of both engines over a match: the value of the target and of the batch.
_MATCH = {
    "fixture_id": "fixture_id", "season": "season", "match_date": "match_date", "kick_off": "concat(CAST(source_match_id % 12 AS STRING), ':30')", "home_team_id": "home_team_id", "away_team_id": "away_team_id", "home_score": "home_score", "away_score": "away_score",
    "referee": "concat('R', CAST(source_match_id % 7 AS STRING))", "venue": "concat('V', CAST(home_team_id AS STRING))", "attendance": "CAST(source_match_id % 9000 AS INTEGER)", "source_name": "'site'", "source_match_id": "CAST(source_match_id AS STRING)",
    "tournament_id": "CAST(1 + season % 2 AS BIGINT)", "competition_stage_id": "CAST(source_match_id % 5 AS BIGINT)", "source_tournament_name": "concat('T', CAST(source_match_id AS STRING))",
    "player_id": "concat('rlp_', CAST(source_match_id AS STRING))", "player_name": "concat('P', CAST(away_team_id AS STRING))", "team_id": "home_team_id", "primary_position": "'FB'", "active": "1", "source_player_id": "CAST(source_match_id AS STRING)",
    "side": "'home'", "position": "'FB'", "lineup_order": "CAST(1 + source_match_id % 17 AS INTEGER)", "is_starting": "1", "source_url": "concat('/matches/', CAST(source_match_id AS STRING))",
    "prediction_date": "match_date", "league_average": "home_score + 0.25", "home_factor": "1.25", "away_factor": "0.75", "home_attack": "1.5", "home_defence": "0.5", "away_attack": "1.125", "away_defence": "0.875", "expected_home": "home_score + 0.5", "expected_away": "away_score + 0.5",
}
_KINDS = {c.split()[0]: c.split()[1] for ddl in tables.SCHEMAS.values() for c in ddl.split(", ")}
_CHANGED = {"string": "concat({0}, '!')", "int": "{0} + 1", "long": "{0} + 1000000", "double": "{0} + 1", "date": "DATE '1990-01-01'"}


def _values(name: str, changed: bool) -> list[str]:
    value = lambda c: _CHANGED[_KINDS[c]].format(_MATCH[c]) if changed and c not in tables.KEYS[name] else _MATCH[c]
    return [f"CAST({value(c)} AS DOUBLE) {c}" if _KINDS[c] == "double" else f"{value(c)} {c}" for c in tables.columns(name)]


def _variant(name: str) -> None:
    """A query that upserts into one table every column changed, for known and for new keys, and its SQL."""
    own, keys_, changing = tables.columns(name), tables.KEYS[name], upsert.UPDATED[name]
    kept = [c if c in keys_ else f"CASE WHEN {'b' if c in changing else 't'}.{keys_[0]} IS NOT NULL THEN {'b' if c in changing else 't'}.{c} ELSE {'t' if c in changing else 'b'}.{c} END AS {c}" for c in own]
    body = f"SELECT {', '.join(kept)} FROM (SELECT {', '.join(_values(name, False))} FROM matches WHERE source_match_id % 2 = 0) t FULL JOIN (SELECT {', '.join(_values(name, True))} FROM matches WHERE source_match_id % 3 = 0) b USING ({', '.join(keys_)})"

    @query(f"a7_{name}_upsert", sql(body, "matches"))
    def _(spark, sf):
        rows = td.view(spark, sf, "matches")
        target = tables.conformed(rows.filter("source_match_id % 2 = 0").selectExpr(*_values(name, False)), name)
        batch = tables.conformed(rows.filter("source_match_id % 3 = 0").selectExpr(*_values(name, True)), name).withColumn("batch_seq", F.lit(1))
        return upsert.upsert_table(name, target, batch, "batch_seq", "2001-01-01 00:00:00").select(*own)


for _name in upsert.UPDATED:
    _variant(_name)


@query("a1_typed_tables", sql(f"SELECT {', '.join(_values('results', False))} FROM results", "results"))
def _(spark, sf):
    # Written untyped (every column a string), read by the declared schema.
    rows = td.results(spark, sf).selectExpr(*[f"CAST({_MATCH[c]} AS STRING) {c}" for c in tables.columns("results")])
    root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    tables.conformed(rows, "results").write.parquet(f"{root}/results")
    return tables.read_table(spark, root, "results").drop("created_at", "updated_at")


@query("a8_violations", sql("""SELECT 'unique(season,source_match_id)' AS rule, concat_ws('|', CAST(season AS VARCHAR), source_match_id) AS key, CAST(count(*) AS VARCHAR) AS detail FROM season_log WHERE source_match_id IS NOT NULL GROUP BY season, source_match_id HAVING count(*) > 1
    UNION ALL SELECT 'points <= 40', fixture_id, CAST(home_score AS VARCHAR) FROM results WHERE home_score > 40
    UNION ALL SELECT DISTINCT 'references(home_team_id)', CAST(home_team_id AS VARCHAR), 'no such row' FROM results WHERE home_team_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)""", "season_log", "results"))
def _(spark, sf):
    log, results = td.view(spark, sf, "season_log"), td.results(spark, sf)
    some = td.table(spark, sf, "supplier").filter("s_suppkey % 3 = 0")
    return integrity.report(
        integrity.unique(log.filter("source_match_id IS NOT NULL"), ["season", "source_match_id"]),
        integrity.check(results, "points <= 40", F.col("home_score") <= 40, ["fixture_id"], F.col("home_score")),
        integrity.references(results, ["home_team_id"], some, ["s_suppkey"]),
        *integrity.results_rules(results),
    )


_VERSIONS = "SELECT concat('v', CAST(season % 2 AS VARCHAR)) matrix_version, make_date(season, 12, 31) as_of_date, home_score, away_score, count(*) n FROM results GROUP BY ALL"


@query("a9_latest_matrix", sql(f"SELECT v.* FROM ({_VERSIONS}) v WHERE as_of_date = (SELECT max(as_of_date) FROM ({_VERSIONS}) m WHERE m.matrix_version = v.matrix_version)", "results"))
def _(spark, sf):
    rows = td.results(spark, sf).groupBy(F.concat(F.lit("v"), (F.col("season") % 2).cast("string")).alias("matrix_version"), F.make_date("season", F.lit(12), F.lit(31)).alias("as_of_date"), "home_score", "away_score").agg(F.count("*").alias("n"))
    return upsert.latest_versions(rows)


@query("a12_season_load", sql("SELECT season, count(*) AS n, sum(CASE WHEN season = 1998 THEN 0 ELSE home_score END) AS points FROM results GROUP BY season", "results"))
def _(spark, sf):
    path = f"{shared_dir(spark)}/by-season-{uuid.uuid4().hex}"
    rows = td.results(spark, sf).select("fixture_id", "season", "home_score")
    upsert.write_seasons(rows, path)
    upsert.write_seasons(rows.filter("season = 1998").withColumn("home_score", F.lit(0)), path)
    return spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("n"), F.sum("home_score").alias("points"))


@query("a13_staged_rebuild", sql(f"SELECT fixture_id, team_id, prior_games, games_used_5, {r('avg_for_10', 'avg_for_10')}, {r('avg_margin_5', 'avg_margin_5')} FROM form", "form"))
def _(spark, sf):
    # Built without a season, which is then loaded late with one score of a known match corrected: form from its first date on is made anew.
    results = td.results(spark, sf).select("fixture_id", "season", "match_date", "home_team_id", "away_team_id", "home_score", "away_score")
    rebuilt = staged.Rebuild(spark, f"{shared_dir(spark)}/rebuild-{uuid.uuid4().hex}", td.AS_OF)
    rebuilt.load(results.filter("season <> 1998").withColumn("home_score", F.when(F.col("match_date") == "1999-03-01", 0).otherwise(F.col("home_score"))))
    rebuilt.step("form", ["results"], rebuilt._form)
    rebuilt.load(results.filter("season = 1998 OR match_date = DATE'1999-03-01'"))
    rebuilt.step("form", ["results"], rebuilt._form)
    return rebuilt.table("form").select("fixture_id", "team_id", "prior_games", "games_used_5", "avg_for_10", "avg_margin_5")


# --- ingestion -----------------------------------------------------------------------------

_STAGE = """CASE WHEN h LIKE '%challenge cup%' OR h LIKE '%world club challenge%' OR h LIKE '%world club series%' OR (h LIKE '%qualifier%' AND h NOT LIKE '%qualif playoff%') OR h LIKE '%million pound game%' OR h LIKE '%kiwis tour%' THEN NULL
    WHEN h LIKE 's8 round%' THEN 'super_8s' WHEN h LIKE '%grand final%' THEN 'grand_final' WHEN h = 'quarter final' THEN 'quarter_final' WHEN h IN ('semi final', 'prelim semi', 'qualif semi') THEN 'semi_final'
    WHEN h = 'prelim final' THEN 'preliminary_final' WHEN h = 'elim' THEN 'elimination_final' WHEN h = 'qualif playoff' THEN 'playoff' WHEN h LIKE 'round %' THEN 'regular_season' END"""
CTES |= {
    "heads": f"SELECT *, {_STAGE} st FROM (SELECT *, lower(trim(regexp_replace(heading, '\\s+', ' ', 'g'))) h FROM season_log)",
    "staged": """SELECT * FROM (SELECT *, last_value(CASE WHEN n_cells <> 10 AND (other_link OR league_link OR st IS NOT NULL) THEN {'stage': CASE WHEN NOT other_link THEN st END} END IGNORE NULLS)
          OVER (PARTITION BY season ORDER BY row_idx ROWS UNBOUNDED PRECEDING) c FROM heads) WHERE n_cells = 10 AND c.stage IS NOT NULL""",
    "dated": """SELECT *, CASE WHEN mon IS NOT NULL THEN CAST(try_strptime(concat_ws(' ', mon, dd, CAST(season AS VARCHAR)), '%b %-d %Y') AS DATE) END match_date FROM (
          SELECT *, last_value(CASE WHEN date_txt LIKE '% %' THEN split_part(date_txt, ' ', 1) END IGNORE NULLS) OVER (PARTITION BY season ORDER BY row_idx ROWS UNBOUNDED PRECEDING) mon,
            CASE WHEN date_txt LIKE '% %' THEN split_part(date_txt, ' ', 2) ELSE date_txt END dd FROM staged)""",
    "logged": """SELECT season, row_idx, c.stage AS stage, match_date, try_cast(nullif(home_score_txt, '') AS INT) home_score, try_cast(nullif(away_score_txt, '') AS INT) away_score,
          try_cast(replace(attendance_txt, ',', '') AS INT) attendance, source_match_id FROM dated WHERE match_date IS NOT NULL""",
    "kept": "SELECT * FROM logged WHERE (home_score IS NULL) = (away_score IS NULL) AND NOT (season < 2023 AND home_score IS NULL)",
}
_TD_BASE |= {"heads": ["season_log"], "staged": ["heads"], "dated": ["staged"], "logged": ["dated"], "kept": ["logged"]}


@query("b1_season_log_matches", sql("SELECT * FROM kept QUALIFY source_match_id IS NULL OR row_number() OVER (PARTITION BY season, source_match_id ORDER BY row_idx) = 1", "kept"))
def _(spark, sf):
    return season_log.matches(td.view(spark, sf, "season_log"), 2023)


@query("b12_completed", sql("SELECT stage, count(*) AS n, sum(home_score) AS home_points FROM (SELECT * FROM kept QUALIFY source_match_id IS NULL OR row_number() OVER (PARTITION BY season, source_match_id ORDER BY row_idx) = 1) WHERE home_score IS NOT NULL GROUP BY stage", "kept"))
def _(spark, sf):
    return season_log.played(season_log.matches(td.view(spark, sf, "season_log"), 2023)).groupBy("stage").agg(F.count("*").alias("n"), F.sum("home_score").alias("home_points"))


@query("b13_heading_audit", sql("SELECT heading, st AS stage, league_link, other_link, count(*) AS n FROM heads WHERE n_cells <> 10 GROUP BY ALL", "heads"))
def _(spark, sf):
    return season_log.headings(td.view(spark, sf, "season_log"))


CTES |= {
    "lo": """SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY row_idx) lineup_order FROM (
          SELECT *, sum(CASE WHEN started AND position = 'HC' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY row_idx) ended FROM (
            SELECT *, max(CASE WHEN position = 'FB' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY row_idx) = 1 started FROM lineup_rows))
        WHERE started AND ended = 0 AND (home_name IS NOT NULL OR away_name IS NOT NULL)""",
    "lp": """SELECT match_id, row_idx, 'home' side, home_name player_name, source_player_id, position, lineup_order FROM lo WHERE home_name IS NOT NULL
        UNION ALL SELECT match_id, row_idx, 'away', away_name, source_player_id, position, lineup_order FROM lo WHERE away_name IS NOT NULL""",
    "squad": """SELECT *, CASE WHEN lineup_order <= 13 THEN 1 ELSE 0 END is_starting FROM (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY lineup_order) nth,
          count(*) FILTER (side = 'home') OVER m h, count(*) FILTER (side = 'away') OVER m a FROM lp WINDOW m AS (PARTITION BY match_id)) WHERE h >= 13 AND a >= 13 AND nth <= 17""",
}
_TD_BASE |= {"lo": ["lineup_rows"], "lp": ["lo"], "squad": ["lp"]}


@query("b9_lineups", sql("SELECT match_id, row_idx, side, player_name, source_player_id, position, lineup_order, is_starting FROM squad", "squad"))
def _(spark, sf):
    return lineups.lineups(td.view(spark, sf, "lineup_rows"))


@query("b10_rejected_lineups", sql("SELECT DISTINCT match_id FROM lineup_rows WHERE match_id NOT IN (SELECT match_id FROM squad)", "squad"))
def _(spark, sf):
    return lineups.rejected(td.view(spark, sf, "lineup_rows"))


_KEY = "CASE WHEN coalesce(source_player_id, '') <> '' THEN concat('rlp_', source_player_id) ELSE concat('rlp_name:', substr(sha1(lower(trim(player_name))), 1, 16)) END"
CTES["app"] = f"SELECT {_KEY} player_id, 2020 + match_id % 5 season, CASE WHEN side = 'home' THEN match_id % 20 ELSE match_id % 20 + 1 END team_id, * FROM squad"
_TD_BASE["app"] = ["squad"]


@query("c12_squads", sql("""SELECT a.player_id, a.season, a.team_id, arg_min(player_name, match_id * 100000000 + row_idx) AS player_name, count(*) AS appearances,
      (SELECT position FROM (SELECT position, count(*) n, min(match_id * 100000000 + row_idx) f FROM app b WHERE b.player_id = a.player_id AND b.season = a.season AND b.team_id = a.team_id GROUP BY position) ORDER BY n DESC, f LIMIT 1) AS primary_position
    FROM app a GROUP BY a.player_id, a.season, a.team_id""", "app"))
def _(spark, sf):
    rows = lineups.lineups(td.view(spark, sf, "lineup_rows"))
    fixtures = td.view(spark, sf, "lineup_rows").select("match_id").distinct().selectExpr("match_id", "2020 + match_id % 5 season", "match_id % 20 home_team_id", "match_id % 20 + 1 away_team_id")
    return lineups.squads(lineups.appearances(rows, fixtures))


@query("c1_valid_mapping", sql("""SELECT DISTINCT a.source_team_name, a.season, arg_max(m.team_id, coalesce(m.valid_from, -1) * 10000000 + m.team_id) AS team_id
    FROM (SELECT s_name source_team_name, season FROM matches JOIN supplier ON s_suppkey = home_team_id) a LEFT JOIN team_map m ON m.source_team_name = a.source_team_name AND (m.valid_from IS NULL OR m.valid_from <= a.season) AND (m.valid_to IS NULL OR m.valid_to >= a.season) GROUP BY ALL""", "matches", "team_map"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey home_team_id", "s_name source_team_name")
    asked = td.view(spark, sf, "matches").join(teams, "home_team_id").select("source_team_name", "season").distinct()
    return keys.valid_mapping(asked, td.view(spark, sf, "team_map"))


@query("c3_new_keys", sql("""SELECT (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0) + row_number() OVER (ORDER BY season, fixture_id, s_name) AS team_id, s_name AS name, season AS valid_from
    FROM (SELECT s_name, min(season) season, arg_min(fixture_id, (season, fixture_id)) fixture_id FROM matches JOIN supplier ON s_suppkey = home_team_id WHERE s_suppkey % 2 = 1 GROUP BY s_name)""", "matches"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey team_id", "s_name name")
    seen = td.view(spark, sf, "matches").join(teams.withColumnRenamed("team_id", "home_team_id"), "home_team_id").select("name", "season", "fixture_id")
    return keys.new_keys(teams.filter("team_id % 2 = 0"), seen, "team_id", "name", ["season", "fixture_id"])


@query("c7_current_tournaments", sql("SELECT team_id, arg_max(t, season * 10 + t) AS tournament_id FROM (SELECT season, season % 3 t, home_team_id team_id FROM matches UNION ALL SELECT season, season % 3, away_team_id FROM matches) GROUP BY team_id", "matches"))
def _(spark, sf):
    return keys.current_tournaments(td.view(spark, sf, "matches").withColumn("tournament_id", F.col("season") % 3))


@query("c10_fixture_match", sql("""SELECT m.source_match_id AS asked, coalesce(f.fixture_id, k.fixture_id) AS fixture_id FROM (SELECT *, CASE WHEN source_match_id % 2 = 0 THEN source_match_id ELSE -source_match_id END sid FROM matches) m
    LEFT JOIN matches f ON f.source_match_id = m.sid AND f.season = m.season
    LEFT JOIN (SELECT season, home_team_id, away_team_id, match_date, min(fixture_id) fixture_id FROM matches GROUP BY ALL HAVING count(*) = 1) k ON k.season = m.season AND k.home_team_id = m.home_team_id AND k.away_team_id = m.away_team_id AND k.match_date = m.match_date""", "matches"))
def _(spark, sf):
    fixtures = td.view(spark, sf, "matches")
    asked = fixtures.select(F.col("source_match_id").alias("asked"), F.when(F.col("source_match_id") % 2 == 0, F.col("source_match_id")).otherwise(-F.col("source_match_id")).alias("source_match_id"), "season", "home_team_id", "away_team_id", "match_date")
    return keys.fixture_of(asked, fixtures).select("asked", "fixture_id")


@query("c11_pending", sql("SELECT source_match_id, status FROM matches WHERE source_match_id % 4 <> 0 AND source_match_id % 3 <> 0", "matches"))
def _(spark, sf):
    rows = td.view(spark, sf, "matches")
    return keys.pending(rows.select("source_match_id", "status"), rows.filter("source_match_id % 4 <> 0"), rows.filter("source_match_id % 3 = 0"))


# --- form and strength -----------------------------------------------------------------------


@query("d2_team_matches", sql("SELECT * FROM tm", "tm"))
def _(spark, sf):
    return form.team_matches(td.results(spark, sf))


_FORM = ", ".join(["fixture_id, team_id, prior_games, games_used_5, games_used_10", *[r(f"avg_{c}_{n}", f"avg_{c}_{n}") for n in (5, 10) for c in ("for", "against", "margin")]])


@query("d3_recent_form", sql(f"SELECT {_FORM} FROM form", "form"))
def _(spark, sf):
    rows = form.recent_form(form.team_matches(td.results(spark, sf)))
    return rows.select("fixture_id", "team_id", "prior_games", "games_used_5", "games_used_10", *[f"avg_{c}_{n}" for n in (5, 10) for c in ("for", "against", "margin")])


@query("e1_league_average", sql(f"SELECT fixture_id, {r('league_average', 'league_average')} FROM league", "league"))
def _(spark, sf):
    return strength.league_average(form.team_matches(td.results(spark, sf)), bucket=2000).filter("is_home = 1").select("fixture_id", "league_average")


@query("e2_opponent_form", sql(f"SELECT f.fixture_id, f.team_id, {r('o.avg_for_5', 'opponent_avg_for_5')}, {r('o.avg_against_5', 'opponent_avg_against_5')}, o.games_used_5 AS opponent_games_used_5 FROM form f LEFT JOIN form o ON o.fixture_id = f.fixture_id AND o.team_id = f.opponent_id", "form"))
def _(spark, sf):
    rows = strength.opponent_form(form.recent_form(form.team_matches(td.results(spark, sf)), (5,)))
    return rows.select("fixture_id", "team_id", "opponent_avg_for_5", "opponent_avg_against_5", "opponent_games_used_5")


@query("e5_raw_multipliers", sql(f"SELECT fixture_id, team_id, {r('ra', 'raw_attack')}, {r('rd', 'raw_defence')} FROM raw", "raw"))
def _(spark, sf):
    rows = strength.league_average(form.recent_form(form.team_matches(td.results(spark, sf)), (5,)))
    return strength.raw_multipliers(rows).select("fixture_id", "team_id", "raw_attack", "raw_defence")


@query("e8_one_pass", sql(f"SELECT fixture_id, team_id, {r('a', 'attack')}, {r('d', 'defence')} FROM st1", "st1"))
def _(spark, sf):
    rows = strength.raw_multipliers(strength.league_average(form.recent_form(form.team_matches(td.results(spark, sf)), (5,))))
    start = written(rows.withColumns({"attack": F.col("raw_attack"), "defence": F.col("raw_defence")}), "pass")
    return strength.one_pass(start).select("fixture_id", "team_id", "attack", "defence")


@query("e9_strength_fixpoint", sql(f"SELECT fixture_id, team_id, {r('a', 'attack')}, {r('d', 'defence')}, {r('sa', 'scaled_attack')}, {r('sd', 'scaled_defence')} FROM strength", "strength"))
def _(spark, sf):
    return strength.strength(form.team_matches(td.results(spark, sf))).select("fixture_id", "team_id", "attack", "defence", "scaled_attack", "scaled_defence")


@query("f2_scoring_factors", sql(f"SELECT match_date, {r('league_average', 'league_average')}, {r('home_factor', 'home_factor')}, {r('away_factor', 'away_factor')} FROM factors", "factors"))
def _(spark, sf):
    return expected.scoring_factors(td.results(spark, sf))


@query("f3_fixture_factors", sql(f"SELECT fixture_id, match_date, {r('league_average', 'league_average')}, {r('home_factor', 'home_factor')}, {r('away_factor', 'away_factor')} FROM results LEFT JOIN factors USING (match_date)", "factors"))
def _(spark, sf):
    return expected.fixture_factors(td.results(spark, sf))


@query("g5_expected_scores", sql(f"SELECT s.fixture_id, {r(_EH, 'expected_home')}, {r(_EA, 'expected_away')}, {r(f'{_EH} - {_EA}', 'expected_margin')}, {r(f'{_EH} + {_EA}', 'expected_total')} FROM sides s JOIN factors USING (match_date) WHERE ha > 0 AND hd > 0 AND aa > 0 AND ad > 0 AND league_average > 0 AND home_factor > 0 AND away_factor > 0", "sides", "factors"))
def _(spark, sf):
    results = td.results(spark, sf)
    rows = expected.expected_scores(rebuild.converged(spark, sf), results)
    return rows.select("fixture_id", "expected_home", "expected_away", "expected_margin", "expected_total")


@query("e6_opponent_multipliers", sql(f"SELECT s.fixture_id, s.team_id, {r('coalesce(o.a, 1.0)', 'opponent_attack')}, {r('coalesce(o.d, 1.0)', 'opponent_defence')} FROM st0 s LEFT JOIN st0 o ON o.fixture_id = s.fixture_id AND o.team_id = s.opponent_id AND o.team_id % 5 > 0", "st0"))
def _(spark, sf):
    rows = strength.raw_multipliers(strength.league_average(form.recent_form(form.team_matches(td.results(spark, sf)), (5,))))
    rows = rows.withColumns({"attack": F.when(F.col("team_id") % 5 > 0, F.col("raw_attack")), "defence": F.when(F.col("team_id") % 5 > 0, F.col("raw_defence"))})
    return strength.opponent_multipliers(rows).select("fixture_id", "team_id", "opponent_attack", "opponent_defence")


@query("e10_strength_table", sql(f"SELECT s.fixture_id, team_id, opponent_id, is_home, s.match_date, season, {r('l', 'league_average')}, {r('ra', 'raw_attack')}, {r('a', 'attack')}, {r('d', 'defence')}, {r('sa', 'scaled_attack')} FROM strength s JOIN (SELECT fixture_id, season FROM results) USING (fixture_id) UNION ALL SELECT 'gone', 1, 2, 1, DATE '1990-01-01', 1990, 20.0, NULL, 9.0, NULL, NULL", "strength", "results"))
def _(spark, sf):
    results = td.results(spark, sf)
    stale = results.filter("season = 1997").selectExpr("fixture_id", "home_team_id team_id", "-1L opponent_id", "9D attack")
    known = stale.unionByName(spark.sql("SELECT 'gone' fixture_id, 1L team_id, 2L opponent_id, 9D attack, 1 is_home, DATE'1990-01-01' match_date, 1990 season, 20D league_average"), allowMissingColumns=True)
    return rebuild.strength_table(results, known).select("fixture_id", "team_id", "opponent_id", "is_home", "match_date", "season", "league_average", "raw_attack", "attack", "defence", "scaled_attack")


@query("g6_expected_table", sql(f"SELECT s.fixture_id, s.match_date, season, home_team_id, away_team_id, {r(_EH, 'expected_home')}, {r(_EA, 'expected_away')}, {r(f'{_EH} - {_EA}', 'expected_margin')} FROM sides s JOIN factors USING (match_date) JOIN (SELECT fixture_id, season, home_team_id, away_team_id FROM results) USING (fixture_id) WHERE ha > 0 AND hd > 0 AND aa > 0 AND ad > 0 AND league_average > 0 AND home_factor > 0 AND away_factor > 0 UNION ALL SELECT 'gone', NULL, NULL, 1, NULL, NULL, NULL, 7.0", "sides", "factors", "results"))
def _(spark, sf):
    results = td.results(spark, sf)
    power = rebuild.converged(spark, sf)
    stale = expected.expected_scores(power, results).filter("fixture_id LIKE '1997%'").select("fixture_id", F.lit(-1).alias("home_team_id"), F.lit(7.0).alias("expected_margin"))
    known = stale.unionByName(spark.sql("SELECT 'gone' fixture_id, 1 home_team_id, 7D expected_margin"))
    return rebuild.expected_table(results, power, known).select("fixture_id", "match_date", "season", "home_team_id", "away_team_id", "expected_home", "expected_away", "expected_margin")


@query("g7_unplayed", sql("SELECT fixture_id, match_date FROM future", "future"))
def _(spark, sf):
    return expected.unplayed(td.view(spark, sf, "matches").drop("home_score", "away_score"), td.results(spark, sf), td.AS_OF).select("fixture_id", "match_date")


@query("g8_asof_form", sql(f"SELECT f.fixture_id, {r('t.margin', 'margin')} FROM future f ASOF LEFT JOIN (SELECT team_id, match_date, arg_max(CAST(margin AS DOUBLE), fixture_id) margin FROM tm GROUP BY ALL) t ON t.team_id = f.home_team_id AND f.match_date > t.match_date", "future", "tm"))
def _(spark, sf):
    probes = td.future(spark, sf).select("fixture_id", "match_date", F.col("home_team_id").alias("team_id"))
    builds = form.team_matches(td.results(spark, sf)).select("team_id", "match_date", "fixture_id", F.col("margin").cast("double").alias("margin"))
    return expected.as_of_last(probes, builds, ["team_id"], "match_date", ["margin"], "fixture_id").select("fixture_id", "margin")


CTES |= {
    "latest": "SELECT team_id, match_date, arg_max(sa, fixture_id) sa, arg_max(sd, fixture_id) sd FROM strength WHERE sa IS NOT NULL AND sd IS NOT NULL GROUP BY ALL",
    "fdays": "SELECT match_date, (h + a) / (2 * n) league_average, (h / n) / ((h + a) / (2 * n)) home_factor, (a / n) / ((h + a) / (2 * n)) away_factor FROM days",
    "fh": "SELECT f.fixture_id, f.match_date, f.away_team_id, l.sa ha, l.sd hd FROM future f ASOF JOIN latest l ON l.team_id = f.home_team_id AND f.match_date > l.match_date",
    "fa": "SELECT f.fixture_id, f.match_date, ha, hd, l.sa aa, l.sd ad FROM fh f ASOF JOIN latest l ON l.team_id = f.away_team_id AND f.match_date > l.match_date",
    "fp": "SELECT f.fixture_id, ha, hd, aa, ad, d.league_average, d.home_factor, d.away_factor FROM fa f ASOF JOIN fdays d ON f.match_date > d.match_date",
}
_TD_BASE |= {"latest": ["strength"], "fdays": ["days"], "fh": ["future", "latest"], "fa": ["fh"], "fp": ["fa", "fdays"]}


@query("g10_predictions", sql(f"SELECT fixture_id, {r('home_factor', 'home_factor')}, {r(_EH, 'expected_home')}, {r(_EA, 'expected_away')} FROM fp WHERE ha > 0 AND hd > 0 AND aa > 0 AND ad > 0", "fp"))
def _(spark, sf):
    return rebuild.predictions(spark, sf).select("fixture_id", "home_factor", "expected_home", "expected_away")


# --- distributions and markets ----------------------------------------------------------------


@query("h2_historical_matrix", sql(f"SELECT season, home_score, away_score, {r('p', 'p')} FROM seasonal", "seasonal"))
def _(spark, sf):
    return seasonal(spark, sf)


_PMF = "SELECT season, k, CASE WHEN eh > 0 THEN exp(-eh + k * ln(eh) - lgamma(k + 1)) END p FROM means, range(0, 101) t(k)"


@query("h5_poisson", sql(f"SELECT season, CAST(k AS INTEGER) AS k, {r('p / sum(p) OVER (PARTITION BY season)', 'p')} FROM ({_PMF})", "means"))
def _(spark, sf):
    means = distributions.implied_means(seasonal(spark, sf), ["season"])
    return distributions.poisson(means, "home_mean", 100).select("season", "k", "p")


@query("h6_poisson_matrix", sql(f"SELECT season, h.k::INTEGER AS home_score, a.k::INTEGER AS away_score, {r('h.p * a.p', 'p')} FROM (SELECT season, k, p / sum(p) OVER (PARTITION BY season) p FROM ({_PMF.replace('101', '61')})) h JOIN (SELECT season, k, p / sum(p) OVER (PARTITION BY season) p FROM ({_PMF.replace('eh', 'ea').replace('101', '61')})) a USING (season)", "means"))
def _(spark, sf):
    means = distributions.implied_means(seasonal(spark, sf), ["season"])
    return distributions.poisson_cells(means, ["season"], "home_mean", "away_mean", 60)


CTES |= {
    "lines": "SELECT home_score hs, away_score s2, count(*) n FROM results GROUP BY ALL",
    "targets": "SELECT season, 18 + season % 7 + 0.25 th, 21 - season % 5 + 0.5 ta FROM (SELECT DISTINCT season FROM results)",
    "sh0": """SELECT season, n, least(greatest(hs * th / mh, 0), 100) x, least(greatest(s2 * ta / ma, 0), 100) y FROM targets, lines,
          (SELECT sum(hs * n) / sum(n)::DOUBLE mh, sum(s2 * n) / sum(n)::DOUBLE ma FROM lines)""",
    "sh": """SELECT season, (floor(x) + i)::INTEGER home_score, (floor(y) + j)::INTEGER away_score, sum(n * CASE WHEN i = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END * CASE WHEN j = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) w
          FROM sh0, range(0, 2) a(i), range(0, 2) b(j) GROUP BY ALL""",
}
_TD_BASE |= {"lines": ["results"], "targets": ["results"], "sh0": ["lines", "targets"], "sh": ["sh0"]}


def _targets(spark, sf):
    return td.results(spark, sf).select("season").distinct().selectExpr("season", "cast(18 + season % 7 + 0.25 as double) th", "cast(21 - season % 5 + 0.5 as double) ta")


@query("h7_shifted_matrix", sql(f"SELECT season, home_score, away_score, {r('w / sum(w) OVER (PARTITION BY season)', 'p')} FROM sh WHERE w > 1e-9", "sh"))
def _(spark, sf):
    cells = distributions.shifted(td.results(spark, sf), _targets(spark, sf), ["season"], "th", "ta")
    return cells.filter("p > 1e-15")


@query("h9_blend", sql(f"SELECT a.season, a.home_score, a.away_score, {r('a.p * 0.8 + 0.2 * b.w / b.t', 'p')} FROM seasonal a JOIN (SELECT season, home_score, away_score, w, sum(w) OVER (PARTITION BY season) t FROM (SELECT season, home_score, away_score, count(*) w FROM results GROUP BY ALL)) b USING (season, home_score, away_score)", "seasonal"))
def _(spark, sf):
    plain = distributions.historical(td.results(spark, sf), "1990-01-01", ["season"])
    return distributions.blended(seasonal(spark, sf), plain, ["season"], 0.2)


@query("h11_tilt_means", sql(f"SELECT fixture_id, {r('15 + home_team_id % 20 + 0.25', 'home_mean', 4)}, {r('30 - away_team_id % 15 + 0.5', 'away_mean', 4)} FROM future", "future"))
def _(spark, sf):
    base = distributions.historical(td.results(spark, sf), td.AS_OF)
    wanted = td.future(spark, sf).selectExpr("fixture_id", "cast(15 + home_team_id % 20 + 0.25 as double) th", "cast(30 - away_team_id % 15 + 0.5 as double) ta")
    tilted = distributions.tilts(base, wanted, "th", "ta")
    side = base.groupBy("home_score").agg(F.sum("p").alias("p"))
    other = base.groupBy("away_score").agg(F.sum("p").alias("p"))

    def mean(marginal: DataFrame, score: str, theta: str, out: str) -> DataFrame:
        rows = tilted.join(F.broadcast(marginal)).withColumn("w", F.col("p") * F.exp(F.col(theta) * (F.col(score) - 25)))  # at most 101 rows
        return rows.groupBy("fixture_id").agg(F.round(F.sum(F.col("w") * F.col(score)) / F.sum("w"), 4).alias(out))

    return mean(side, "home_score", "theta_home", "home_mean").join(mean(other, "away_score", "theta_away", "away_mean"), "fixture_id")


@query("h12_matrix_rules", sql(f"SELECT season, {r('sum(p)', 'mass')}, {r('min(p)', 'least')}, max(greatest(home_score, away_score)) AS largest, true AS ok FROM seasonal GROUP BY season", "seasonal"))
def _(spark, sf):
    return distributions.matrix_rules(seasonal(spark, sf), ["season"])


@query("h13_implied_means", sql(f"SELECT season, {r('eh', 'home_mean')}, {r('ea', 'away_mean')} FROM means", "means"))
def _(spark, sf):
    return distributions.implied_means(seasonal(spark, sf), ["season"])


@query("h15_buckets", sql(f"SELECT season, (home_score // 2 * 2)::INTEGER AS home_score, (away_score // 2 * 2)::INTEGER AS away_score, {r('sum(p)', 'p')} FROM seasonal WHERE home_score <= 40 AND away_score <= 40 GROUP BY 1, 2, 3", "seasonal"))
def _(spark, sf):
    return distributions.bucketed(seasonal(spark, sf), ["season"], 2, 40)


@query("h18_smoothed", sql(f"SELECT h.k::INTEGER AS home_score, a.k::INTEGER AS away_score, {r('(coalesce(n, 0) + 1e-6) / sum(coalesce(n, 0) + 1e-6) OVER ()', 'p')} FROM range(0, 81) h(k), range(0, 81) a(k) LEFT JOIN (SELECT home_score, away_score, count(*)::DOUBLE n FROM results GROUP BY ALL) c ON c.home_score = h.k AND c.away_score = a.k", "results"))
def _(spark, sf):
    counts = td.results(spark, sf).groupBy("home_score", "away_score").agg(F.count("*").cast("double").alias("p"))
    return distributions.smoothed(counts, 80)


@query("h19_joint_tilt_means", sql(f"SELECT season, {r('th', 'home_mean', 4)}, {r('ta', 'away_mean', 4)} FROM targets", "targets"))
def _(spark, sf):
    base, wanted = seasonal(spark, sf), _targets(spark, sf)
    solved = distributions.joint_tilts(base, wanted.withColumn("id", F.col("season")), "season", "id", "th", "ta", 50)
    # The solver sees every cell of the grid, the empty ones with a floor of 1e-12.
    n = spark.range(51)
    grid = n.select(F.col("id").cast("int").alias("home_score")).join(n.select(F.col("id").cast("int").alias("away_score")))
    full = F.broadcast(grid).join(wanted.select("season")).join(base, ["season", "home_score", "away_score"], "left").withColumn("p", F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-12)))
    w = F.col("p") * F.exp(F.col("theta_home") * (F.col("home_score") - 25) + F.col("theta_away") * (F.col("away_score") - 25))
    rows = full.join(solved.withColumnRenamed("id", "season"), "season").withColumn("w", w)
    return rows.groupBy("season").agg(F.round(F.sum(F.col("w") * F.col("home_score")) / F.sum("w"), 4).alias("home_mean"), F.round(F.sum(F.col("w") * F.col("away_score")) / F.sum("w"), 4).alias("away_mean"))


_PRICE = "CASE WHEN probability > 0 THEN round(1.0 / probability, 4) + 0.0 ELSE 'inf'::DOUBLE END AS decimal_price"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"decimal_price": F.round("decimal_price", 4), "probability": F.round("probability", 6)})


@query("i2_match_odds", sql(f"""SELECT season, 'match_odds' AS market, selection, NULL::DOUBLE AS line, {r('probability', 'probability')}, {_PRICE} FROM (
    SELECT season, CASE WHEN home_score > away_score THEN 'home' WHEN home_score = away_score THEN 'draw' ELSE 'away' END selection, sum(p) probability FROM seasonal GROUP BY ALL)""", "seasonal"))
def _(spark, sf):
    return _shown(markets.match_odds(seasonal(spark, sf), ["season"]))


CTES |= {
    "hl": "SELECT season, floor(-(eh - ea)) + 0.5 + k line FROM means, range(-20, 21) t(k)",
    "hp": "SELECT season, line, sum(CASE WHEN home_score - away_score + line > 0 THEN p ELSE 0 END) home FROM hl JOIN seasonal USING (season) GROUP BY ALL",
    "tl": "SELECT season, k + 0.5 line FROM (SELECT season, unnest(range(floor(round(eh + ea, 9) - 20)::BIGINT, ceil(round(eh + ea, 9) + 20)::BIGINT + 1)) k FROM means)",
    "tp": "SELECT season, line, sum(CASE WHEN home_score + away_score > line THEN p ELSE 0 END) over_ FROM tl JOIN seasonal USING (season) GROUP BY ALL",
}
_TD_BASE |= {"hl": ["means"], "hp": ["hl", "seasonal"], "tl": ["means"], "tp": ["tl", "seasonal"]}


@query("i5_handicap_ladder", sql(f"SELECT season, 'handicap' AS market, selection, line::DOUBLE AS line, {r('probability', 'probability')} FROM (SELECT season, line, 'home' selection, home probability FROM hp UNION ALL SELECT season, line, 'away', 1 - home FROM hp)", "hp"))
def _(spark, sf):
    cells = seasonal(spark, sf)
    means = distributions.implied_means(cells, ["season"])
    return markets.handicap_ladder(markets.margins(cells, ["season"]), means, ["season"], "home_mean", "away_mean").drop("decimal_price")


@query("i6_totals_ladder", sql(f"SELECT season, 'totals' AS market, selection, line::DOUBLE AS line, {r('probability', 'probability')} FROM (SELECT season, line, 'over' selection, over_ probability FROM tp UNION ALL SELECT season, line, 'under', 1 - over_ FROM tp)", "tp"))
def _(spark, sf):
    return markets.totals_ladder(markets.totals(seasonal(spark, sf), ["season"]), ["season"]).drop("decimal_price")


@query("i7_totals_mainline", sql("SELECT season, line::DOUBLE AS line FROM tp QUALIFY row_number() OVER (PARTITION BY season ORDER BY round(abs(over_ - 0.5), 12), line) = 1", "tp"))
def _(spark, sf):
    return markets.totals_mainline(markets.totals_ladder(markets.totals(seasonal(spark, sf), ["season"]), ["season"]), ["season"])


@query("i8_display_ladder", sql(f"SELECT season, line::DOUBLE AS line, {r('home', 'home_probability')}, {r('1 - home', 'away_probability')} FROM hp JOIN means USING (season) WHERE (line - (floor(-(eh - ea)) + 0.5))::INTEGER % 2 = 0", "hp"))
def _(spark, sf):
    cells = seasonal(spark, sf)
    means = distributions.implied_means(cells, ["season"])
    ladder = markets.handicap_ladder(markets.margins(cells, ["season"]), means, ["season"], "home_mean", "away_mean")
    main = means.select("season", markets.handicap_mainline(F.col("home_mean"), F.col("away_mean")).alias("line"))
    return markets.display(ladder, main, ["season"], ("home", "away")).drop("home_decimal_price", "away_decimal_price")


#: Newton steps of the SQL on each side's exponent.
_TILTS = 25
CTES |= {
    "ib": f"""SELECT i, j, w / sum(w) OVER () p FROM (SELECT least(home_score, 100) i, least(away_score, 100) j, sum(CASE WHEN y <= 2 THEN 1.0 WHEN y <= 4 THEN 0.5 WHEN y <= 6 THEN 0.25 WHEN y <= 999 THEN 0.1 ELSE 0 END::DOUBLE) w
        FROM (SELECT *, date_diff('day', match_date, DATE '{td.AS_OF}') / 365.25::DOUBLE y FROM results) GROUP BY ALL)""",
    "im": "SELECT 'h' side, i k, sum(p) q FROM ib GROUP BY ALL UNION ALL SELECT 'a', j, sum(p) FROM ib GROUP BY ALL",
    "ie": f"SELECT fixture_id, {_EH} eh, {_EA} ea FROM fp WHERE ha > 0 AND hd > 0 AND aa > 0 AND ad > 0",
    "it0": "SELECT fixture_id, unnest(['h', 'a']) side, unnest([eh, ea]) target, 0::DOUBLE t FROM ie",
}
_TD_BASE |= {"ib": ["results"], "im": ["ib"], "ie": ["fp"], "it0": ["ie"]}
for _k in range(_TILTS):
    CTES[f"it{_k + 1}"] = f"""SELECT fixture_id, side, target, t + (target - m) / v t FROM (SELECT fixture_id, side, target, t, sum(k * w) / sum(w) m, sum(k * k * w) / sum(w) - pow(sum(k * w) / sum(w), 2) v
        FROM (SELECT *, q * exp(t * k) w FROM it{_k} JOIN im USING (side)) GROUP BY ALL)"""
    _TD_BASE[f"it{_k + 1}"] = [f"it{_k}", "im"]
CTES |= {
    "ip": f"""SELECT fixture_id, i, j, w / sum(w) OVER (PARTITION BY fixture_id) p FROM (SELECT h.fixture_id, i, j, p * exp(h.t * i + a.t * j) w
        FROM it{_TILTS} h JOIN it{_TILTS} a ON a.fixture_id = h.fixture_id AND h.side = 'h' AND a.side = 'a', ib)""",
    "iw": "SELECT fixture_id, i - j m, sum(p) p FROM ip GROUP BY ALL",
    "iu": "SELECT fixture_id, i + j s, sum(p) p FROM ip GROUP BY ALL",
    "iy": "SELECT fixture_id, line, coalesce(sum(p) FILTER (m + line > 0), 0) home FROM (SELECT fixture_id, floor(-(eh - ea)) + 0.5 + x line FROM ie, range(-20, 21) k(x)) JOIN iw USING (fixture_id) GROUP BY ALL",
    "iz": """SELECT fixture_id, line, coalesce(sum(p) FILTER (s > line), 0) over_ FROM (SELECT fixture_id, unnest(range(floor(round(mean, 9) - 20)::BIGINT, ceil(round(mean, 9) + 20)::BIGINT + 1)) + 0.5 line
        FROM (SELECT fixture_id, sum(s * p) mean FROM iu GROUP BY fixture_id)) JOIN iu USING (fixture_id) GROUP BY ALL""",
    "io": "SELECT fixture_id, coalesce(sum(p) FILTER (m > 0), 0) h, coalesce(sum(p) FILTER (m = 0), 0) d FROM iw GROUP BY fixture_id",
    "ia": """SELECT fixture_id, 'match_odds' market, unnest(['home', 'draw', 'away']) selection, NULL::DOUBLE line, unnest([h, d, 1 - h - d]) p FROM io
        UNION ALL SELECT fixture_id, 'handicap', unnest(['home', 'away']), line::DOUBLE, unnest([home, 1 - home]) FROM iy
        UNION ALL SELECT fixture_id, 'totals', unnest(['over', 'under']), line::DOUBLE, unnest([over_, 1 - over_]) FROM iz""",
}
_TD_BASE |= {"ip": [f"it{_TILTS}", "ib"], "iw": ["ip"], "iu": ["ip"], "iy": ["ie", "iw"], "iz": ["iu"], "io": ["iw"], "ia": ["io", "iy", "iz"]}


@query("i8_price_all_fixtures", sql(f"SELECT fixture_id, market, selection, line, {r('p', 'probability')}, round(CASE WHEN p > 0 THEN 1 / p ELSE 'inf'::DOUBLE END, 4) AS decimal_price FROM ia", "ia"))
def _(spark, sf):
    return rebuild.prices(spark, sf).withColumn("decimal_price", F.round("decimal_price", 4))


# --- ratings, backtests, studies ---------------------------------------------------------------


@query("j1_tries", sql(f"SELECT fixture_id, CAST(team_id AS VARCHAR) AS team, CAST(opponent_id AS VARCHAR) AS opponent, is_home::DOUBLE AS is_home, CAST(season AS VARCHAR) AS season, {r('points_for / 5.2', 'tries')} FROM tm", "tm"))
def _(spark, sf):
    return ratings.tries(td.results(spark, sf))


def season_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.fit(ratings.tries(td.results(spark, sf_dir)))


def rated_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixtures, played or to come, as the ratings name them."""
    return td.view(spark, sf_dir, "matches").selectExpr("fixture_id", "CAST(season AS STRING) season", "CAST(home_team_id AS STRING) home_team", "CAST(away_team_id AS STRING) away_team")


#: Sweeps of the SQL; the plan stops by tolerance.
_SWEEPS = 40
CTES |= {
    "jp": """SELECT season, CAST(team_id AS VARCHAR) team, CAST(opponent_id AS VARCHAR) opponent, sum(is_home)::DOUBLE gh, sum(1 - is_home)::DOUBLE ga, sum(points_for / 5.2::DOUBLE) y, sum(is_home * points_for / 5.2::DOUBLE) yh FROM tm GROUP BY ALL""",
    "jt": """SELECT season, team, t, c, yh FROM (SELECT season, team, sum(y) t FROM jp GROUP BY ALL) JOIN (SELECT season, opponent team, sum(y) c FROM jp GROUP BY ALL) USING (season, team) JOIN (SELECT season, sum(yh) yh FROM jp GROUP BY ALL) USING (season)""",
    "jd0": "SELECT season, team, t, c, yh, 1.0::DOUBLE a, 1.0::DOUBLE d, 1.0::DOUBLE h FROM jt",
}
_TD_BASE |= {"jp": ["tm"], "jt": ["jp"], "jd0": ["jt"]}
for _k in range(_SWEEPS):
    _half = "SELECT season, team, t, c, yh, {0} {1}, {2}, yh / sum({0} * eh) OVER (PARTITION BY season) h FROM {3} JOIN (SELECT jp.season, jp.{4} team, sum(gh * {2}) eh, sum(ga * {2}) ea FROM jp JOIN {3} e ON e.season = jp.season AND e.team = jp.{5} GROUP BY ALL) USING (season, team)"
    CTES[f"ja{_k + 1}"] = _half.format("t / (h * eh + ea)", "a", "d", f"jd{_k}", "team", "opponent")
    CTES[f"jd{_k + 1}"] = _half.format("c / (h * eh + ea)", "d", "a", f"ja{_k + 1}", "opponent", "team")
    _TD_BASE |= {f"ja{_k + 1}": [f"jd{_k}"], f"jd{_k + 1}": [f"ja{_k + 1}"]}
CTES |= {
    "jr": f"SELECT season, team, a, d, h, ln(a / first(a) OVER w) te, ln(d / first(d) OVER w) oe, ln(h) he, ln(first(a) OVER w * first(d) OVER w) ic FROM jd{_SWEEPS} WINDOW w AS (PARTITION BY season ORDER BY team)",
    "jm": "SELECT CAST(season AS VARCHAR) season, fixture_id, h.h * h.a * a.d eh, a.a * h.d ea FROM (SELECT fixture_id, season, CAST(home_team_id AS VARCHAR) ht, CAST(away_team_id AS VARCHAR) awt FROM matches) JOIN jr h USING (season) JOIN jr a USING (season) WHERE h.team = ht AND a.team = awt",
    "jx": "SELECT fixture_id, sum(CASE WHEN i > j THEN p ELSE 0 END) h, sum(CASE WHEN i = j THEN p ELSE 0 END) d, sum(CASE WHEN i < j THEN p ELSE 0 END) a FROM (SELECT fixture_id, i, j, exp(i * ln(eh) - eh - lgamma(i + 1)) * exp(j * ln(ea) - ea - lgamma(j + 1)) p FROM jm, range(0, 17) x(i), range(0, 17) y(j)) GROUP BY fixture_id",
}
_TD_BASE |= {"jr": [f"jd{_SWEEPS}"], "jm": ["jr", "matches"], "jx": ["jm"]}


@query("j2_poisson_ratings", sql(f"SELECT CAST(season AS VARCHAR) AS season, team, {r('te', 'team_effect')}, {r('oe', 'opponent_effect')}, {r('he', 'home_effect')}, {r('ic', 'intercept')} FROM jr", "jr"))
def _(spark, sf):
    return ratings.coefficients(season_ratings(spark, sf))


@query("j3_expected_tries", sql(f"SELECT fixture_id, season, {r('eh', 'expected_home_tries')}, {r('ea', 'expected_away_tries')} FROM jm", "jm"))
def _(spark, sf):
    return ratings.expected_tries(season_ratings(spark, sf), rated_fixtures(spark, sf)).drop("home_team", "away_team")


@query("j3_unseen_teams", sql("SELECT fixture_id, CAST(season AS VARCHAR) AS season, CAST(team AS VARCHAR) AS team FROM (SELECT fixture_id, season + 1 season, unnest([home_team_id, away_team_id]) team FROM matches WHERE home_team_id % 10 < 2) m WHERE NOT EXISTS (SELECT 1 FROM tm WHERE tm.season = m.season AND tm.team_id = m.team)", "matches", "tm"))
def _(spark, sf):
    # Fixtures moved to the season after: the ratings of that season miss some teams, and there are none of the last one.
    moved = rated_fixtures(spark, sf).filter("CAST(home_team AS LONG) % 10 < 2").withColumn("season", (F.col("season").cast("int") + 1).cast("string"))
    return ratings.unseen(season_ratings(spark, sf), moved)


@query("j4_match_chances", sql(f"SELECT fixture_id, {r('h / (h + d + a)', 'home')}, {r('d / (h + d + a)', 'draw')}, {r('a / (h + d + a)', 'away')} FROM jx", "jx"))
def _(spark, sf):
    means = ratings.expected_tries(season_ratings(spark, sf), rated_fixtures(spark, sf))
    return ratings.match_chances(means, ["fixture_id"], "expected_home_tries", "expected_away_tries")


@query("k2_absolute_errors", sql(f"SELECT {r('avg(abs(home_score - expected_home))', 'home')}, {r('avg(abs(away_score - expected_away))', 'away')}, {r('avg(abs(home_score - away_score - expected_home + expected_away))', 'margin')}, {r('avg(abs(home_score + away_score - expected_home - expected_away))', 'total')} FROM fe", "fe"))
def _(spark, sf):
    return backtest.mean_absolute_errors(backtest.evaluation_set(rebuild.expectations(spark, sf)))


@query("k3_split_date", sql("SELECT match_date AS start FROM (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT match_date FROM fe)) WHERE i = floor(n * 0.75)", "fe"))
def _(spark, sf):
    return backtest.split_date(rebuild.expectations(spark, sf))


_EVENTS = """e.fixture_id, e.season, ah, aa, tl, ml, sum(CASE WHEN p.home_score = ah AND p.away_score = aa THEN p ELSE 0 END) s, sum(CASE WHEN p.home_score > p.away_score THEN p ELSE 0 END) h, sum(CASE WHEN p.home_score = p.away_score THEN p ELSE 0 END) d,
    sum(CASE WHEN p.home_score < p.away_score THEN p ELSE 0 END) a, sum(CASE WHEN p.home_score + p.away_score > tl THEN p ELSE 0 END) o, sum(CASE WHEN p.home_score - p.away_score > ml THEN p ELSE 0 END) c, sum(p.home_score * p) hm, sum(p.away_score * p) am"""
_FOLDED = """SELECT fixture_id, k, CASE WHEN k < 80 THEN q ELSE 1 - sum(CASE WHEN k < 80 THEN q ELSE 0 END) OVER (PARTITION BY fixture_id) END p
    FROM (SELECT fixture_id, k, CASE WHEN expected_{side} > 0 THEN exp(-expected_{side} + k * ln(expected_{side}) - lgamma(k + 1)) ELSE (k = 0)::INT END q FROM ev, range(0, 81) t(k))"""
_CLIP = "least(greatest({0}, 1e-12), 1 - 1e-12)"
_LOSS = f"""SELECT *, -ln({_CLIP.format('s')}) sl, -ln({_CLIP.format('CASE WHEN ah > aa THEN h WHEN ah = aa THEN d ELSE a END')}) rl,
    pow(h - (ah > aa)::INT, 2) + pow(d - (ah = aa)::INT, 2) + pow(a - (ah < aa)::INT, 2) br,
    -CASE WHEN ah - aa > ml THEN ln({_CLIP.format('c')}) ELSE ln(1 - {_CLIP.format('c')}) END hl, -CASE WHEN ah + aa > tl THEN ln({_CLIP.format('o')}) ELSE ln(1 - {_CLIP.format('o')}) END ll FROM sw"""


CTES |= {
    "ev": "SELECT fe.*, home_score ah, away_score aa, floor(expected_home + expected_away) + 0.5 tl, floor(expected_home - expected_away) + 0.5 ml FROM fe WHERE match_date >= (SELECT match_date FROM (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT match_date FROM fe)) WHERE i = floor(n * 0.75))",
    "wf": """SELECT d.match_date as_of, c.home_score, c.away_score, sum(n * CASE WHEN y <= 2 THEN 1 WHEN y <= 4 THEN 0.5 ELSE 0.5 * pow(0.5, (y - 4) / 2) END) w FROM (
          SELECT d.match_date d, c.*, date_diff('day', c.match_date, d.match_date) / 365.25::DOUBLE y FROM (SELECT DISTINCT match_date FROM ev) d
          JOIN (SELECT match_date, home_score, away_score, count(*) n FROM results GROUP BY ALL) c ON c.match_date < d.match_date) c(d, match_date, home_score, away_score, n, y), LATERAL (SELECT c.d match_date) d GROUP BY ALL""",
    "wp": """SELECT m.as_of, h.k home_score, a.k away_score, (coalesce(w, 0) + 1e-6) / (mass + 6561e-6) p FROM (SELECT as_of, sum(w) mass FROM wf GROUP BY as_of) m CROSS JOIN range(0, 81) h(k) CROSS JOIN range(0, 81) a(k)
        LEFT JOIN wf ON wf.as_of = m.as_of AND wf.home_score = h.k AND wf.away_score = a.k""",
    "evh": f"SELECT {_EVENTS} FROM ev e JOIN wp p ON p.as_of = e.match_date GROUP BY ALL",
    "ph": f"SELECT fixture_id, k, p FROM ({_FOLDED.format(side='home')})",
    "pa": f"SELECT fixture_id, k, p FROM ({_FOLDED.format(side='away')})",
    "evp": f"SELECT {_EVENTS} FROM ev e JOIN (SELECT fixture_id f, ph.k home_score, pa.k away_score, ph.p * pa.p p FROM ph JOIN pa USING (fixture_id)) p ON p.f = e.fixture_id GROUP BY ALL",
    "sw": "SELECT fixture_id, season, weight, ah, aa, tl, ml, " + ", ".join(f"x.{c} * (1 - weight / 100.0::DOUBLE) + y.{c} * (weight / 100.0::DOUBLE) {c}" for c in ("s", "h", "d", "a", "o", "c", "hm", "am")) + f" FROM evp x JOIN (SELECT fixture_id, s, h, d, a, o, c, hm, am FROM evh) y USING (fixture_id), (SELECT unnest([{', '.join(map(str, backtest.WEIGHTS))}]) weight)",
    "ls": f"SELECT *, abs(hm - ah) home_error, abs(am - aa) away_error FROM ({_LOSS})",
}
_TD_BASE |= {"ev": ["fe"], "wf": ["ev"], "wp": ["wf"], "evh": ["wp"], "ph": ["ev"], "pa": ["ev"], "evp": ["ph", "pa"], "sw": ["evp", "evh"], "ls": ["sw"]}


def _evaluated(spark, sf):
    """All fixtures from the split date on."""
    fixtures = rebuild.expectations(spark, sf)
    fixtures = fixtures.join(F.broadcast(backtest.split_date(fixtures)), F.col("match_date") >= F.col("start"))  # one row
    lines = {"ah": F.col("home_score"), "aa": F.col("away_score"), "total_line": F.floor(F.col("expected_home") + F.col("expected_away")) + 0.5, "margin_line": F.floor(F.col("expected_home") - F.col("expected_away")) + 0.5, "as_of": F.col("match_date")}
    asked = fixtures.withColumns(lines).select("fixture_id", "season", "as_of", "ah", "aa", "total_line", "margin_line", "expected_home", "expected_away")
    return written(asked, "evaluated")


def _history_events(spark, sf, asked):
    return backtest.history_events(rebuild.played(spark, sf), asked, "hist")


@query("k4_walk_forward", sql(f"SELECT fixture_id, {r('h', 'p_home')}, {r('d', 'p_draw')}, {r('o', 'p_over')}, {r('c', 'p_cover')} FROM evh", "evh"))
def _(spark, sf):
    rows = _history_events(spark, sf, _evaluated(spark, sf))
    return rows.select("fixture_id", *[F.col(f"hist_{c}").alias(c) for c in ("p_home", "p_draw", "p_over", "p_cover")])


@query("k6_losses", sql(f"SELECT count(*) AS fixtures, {r('avg(rl)', 'result_loss')}, {r('avg(br)', 'result_brier')}, {r('avg(hl)', 'handicap_loss')}, {r('avg(ll)', 'total_loss')} FROM ({_LOSS.replace('FROM sw', 'FROM evh')})", "evh"))
def _(spark, sf):
    rows = _history_events(spark, sf, _evaluated(spark, sf))
    named = rows.withColumnsRenamed({f"hist_{c}": c for c in (*backtest.EVENTS, "home_mean", "away_mean")})
    return backtest.losses(named).agg(F.count("*").alias("fixtures"), *[F.avg(c).alias(c) for c in ("result_loss", "result_brier", "handicap_loss", "total_loss")])


def _both_models(spark, sf):
    return backtest.poisson_events(_history_events(spark, sf, _evaluated(spark, sf)), "expected_home", "expected_away", "poisson")


def _swept(spark, sf):
    return backtest.losses(backtest.sweep(_both_models(spark, sf), "poisson", "hist"))


#: Metrics and their names in the view ls.
_MEANS = {"score_loss": "sl", "result_loss": "rl", "result_brier": "br", "handicap_loss": "hl", "total_loss": "ll", "home_error": "home_error", "away_error": "away_error"}
_SUMMARY = "count(DISTINCT fixture_id) AS fixtures, " + ", ".join(r(f"avg({c})", m) for m, c in _MEANS.items())


def _best(by: str) -> str:
    named = f"SELECT {by} weight, " + ", ".join(f"round(avg({c}), 9) {m}" for m, c in _MEANS.items()) + f" FROM ls GROUP BY {by} weight"
    return " UNION ALL ".join(f"SELECT {by} '{m}' AS metric, arg_min(weight, (v, weight)) AS weight, {r('min(v)', 'value')} FROM (SELECT {by} weight, {m} v FROM ({named})) GROUP BY ALL" for m in _MEANS)


@query("k7_weight_summary", sql(f"SELECT weight, {_SUMMARY} FROM ls GROUP BY weight", "ls"))
def _(spark, sf):
    return backtest.swept_summary(_both_models(spark, sf), "poisson", "hist")


@query("k8_best_weights", sql(_best(""), "ls"))
def _(spark, sf):
    return backtest.best(backtest.summary(_swept(spark, sf), ["weight"]))


_DIFFERENCES = {(m, w): f"d_{m}_{w}" for m in backtest.METRICS for w in backtest.COMPARED}
CTES |= {
    "dw": "SELECT fixture_id, " + ", ".join(f"max(CASE WHEN weight = {w} THEN {_MEANS[m]} END) - max(CASE WHEN weight = 0 THEN {_MEANS[m]} END) {c}" for (m, w), c in _DIFFERENCES.items()) + " FROM ls GROUP BY fixture_id",
    "dx": "SELECT fixture_id, rep, (('0x' || substr(md5(concat_ws('|', fixture_id, 42)), 1, 8))::BIGINT % 2147483647 + rep * (('0x' || substr(md5(concat_ws('|', fixture_id, 42)), 9, 8))::BIGINT % 2147483647)) % 2147483647 x FROM ev, range(1, 2001) t(rep)",
    "dr": f"SELECT fixture_id, rep, {' + '.join(f'(u >= {c})::INT' for c in backtest.DRAWS)} n FROM (SELECT fixture_id, rep, ((x * x % 2147483647) * (x * x % 2147483647) % 2147483647) * x % 2147483647 / 2147483647::DOUBLE u FROM dx)",
    "bm": "SELECT rep, " + ", ".join(f"sum(n * {c}) / sum(n) {c}" for c in _DIFFERENCES.values()) + " FROM dr JOIN dw USING (fixture_id) GROUP BY rep",
}
_TD_BASE |= {"dw": ["ls"], "dx": ["ev"], "dr": ["dx"], "bm": ["dw", "dr"]}


@query("k10_bootstrap", sql(" UNION ALL ".join(f"SELECT {w} AS weight, '{m}' AS metric, {r(f'avg({c})', 'mean')}, {r(f'quantile_cont({c}, 0.025)', 'low')}, {r(f'quantile_cont({c}, 0.975)', 'high')}, {r(f'avg(({c} < 0)::INT)', 'share_better')} FROM bm" for (m, w), c in _DIFFERENCES.items()), "bm"))
def _(spark, sf):
    rows = backtest.losses(backtest.sweep(_both_models(spark, sf), "poisson", "hist", (0, *backtest.COMPARED)))
    return backtest.bootstrap(rows)


@query("l2_outliers", sql(f"SELECT outlier, count(*) AS n, {r('avg(residual)', 'mean')} FROM flag GROUP BY outlier", "flag"))
def _(spark, sf):
    return residuals.flagged(residuals.team_residuals(rebuild.expectations(spark, sf))).groupBy("outlier").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"))


CTES["treat"] = """SELECT *, expected + residual o_raw, expected + least(greatest(residual, -15), 15) o_capped, expected + CASE WHEN outlier THEN residual * 0.75 ELSE residual END o_shrunk,
    expected + least(greatest(residual, q05), q95) o_winsor, expected + least(greatest(residual, mu - 1.5 * sd), mu + 1.5 * sd) o_huber FROM flag"""
_TD_BASE["treat"] = ["flag"]


@query("l3_treatments", sql(f"SELECT fixture_id, team_id, outlier, {', '.join(r(f'o_{m}', f'observed_{m}') for m in residuals.METHODS)} FROM treat", "treat"))
def _(spark, sf):
    rows = residuals.treated(residuals.flagged(residuals.team_residuals(rebuild.expectations(spark, sf))))
    return rows.select("fixture_id", "team_id", "outlier", *[f"observed_{m}" for m in residuals.METHODS])


def _past(c: str) -> str:
    return "(" + " + ".join(f"{6 - k} * coalesce(lag({c}, {k}) OVER w, 0)" for k in range(1, 6)) + ")"


CTES["pred"] = "SELECT *, " + ", ".join(f"CASE WHEN {_past('expected')} > 0 THEN expected * {_past(f'o_{m}')} / {_past('expected')} END p_{m}" for m in residuals.METHODS) + " FROM treat WINDOW w AS (PARTITION BY team_id ORDER BY match_date, fixture_id)"
_TD_BASE["pred"] = ["treat"]
_BOARD = " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) AS n, {r(f'avg(p_{m})', 'mean_predicted')}, {r(f'avg(p_{m} - observed)', 'bias')}, {r(f'avg(abs(p_{m} - observed))', 'mae')}, {r(f'sqrt(avg((p_{m} - observed) ** 2))', 'rmse')}, {r(f'corr(p_{m}, observed)', 'correlation')} FROM pred WHERE p_{m} IS NOT NULL" for m in residuals.METHODS)


def _recent_ratios(spark, sf):
    rows = residuals.flagged(residuals.team_residuals(rebuild.expectations(spark, sf)), team_order=True)
    return residuals.predictions(residuals.treated(rows))


@query("l5_leaderboard", sql(_BOARD, "pred"))
def _(spark, sf):
    return residuals.leaderboard(_recent_ratios(spark, sf)).select("method", "n", "mean_predicted", "bias", "mae", "rmse", "correlation")


@query("l7_after_outlier", sql(f"SELECT count(*) AS n, {r('avg(residual)', 'mean')} FROM (SELECT residual, lag(outlier, 1, false) OVER (PARTITION BY team_id ORDER BY match_date, fixture_id) was FROM flag) WHERE was", "flag"))
def _(spark, sf):
    return residuals.after_outlier(residuals.flagged(residuals.team_residuals(rebuild.expectations(spark, sf)))).agg(F.count("*").alias("n"), F.avg("residual").alias("mean"))


@query("l9_largest_residuals", sql(f"SELECT fixture_id, team_id, {r('residual', 'residual')} FROM res ORDER BY abs(residual) DESC, fixture_id, team_id LIMIT 30", "res"))
def _(spark, sf):
    return residuals.largest(residuals.team_residuals(rebuild.expectations(spark, sf))).select("fixture_id", "team_id", "residual")


def strength_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team rows of played fixtures: observed and expected score, attack, opponent's defence, all of the fixpoint."""
    return team_rows(rebuild.expectations(spark, sf_dir))


def team_rows(rows: DataFrame) -> DataFrame:
    """Two rows a fixture with multipliers: observed and expected score of each side, its attack and the other's defence."""

    def side(own: str, other: str, home: int):
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"), F.lit(home).alias("is_home"), F.col(f"{own}_score").cast("double").alias("observed"), F.col(f"expected_{own}").alias("expected"),
            F.col(f"{own}_attack").alias("attack"), F.col(f"{other}_defence").alias("opponent_defence"),
        )

    both = F.array(side("home", "away", 1), side("away", "home", 0))
    return rows.select("fixture_id", "match_date", F.explode(both).alias("x")).select("fixture_id", "match_date", "x.*")


def _curve(x: str) -> str:
    reach = f"least(abs(({x} - 1) * rate) / cap_start, 1)"
    return f"(1 + sign(({x} - 1) * rate) * max_edit * (2 * {reach} - {reach} * {reach}))"


_GRID = residuals.grid([0.3, 0.4, 0.5, 0.6, 0.75, 1.0], [round(0.05 * k, 2) for k in range(4, 17)], [0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
_CAPS = residuals.grid([0.3, 0.4, 0.5, 0.6, 0.75], [0.15, 0.2, 0.25, 0.3, 0.35], [1.0])
_PRICED = f"expected * ({_curve('attack')} / attack) * ({_curve('opponent_defence')} / opponent_defence)"


def _grid_sql(points: list[tuple[int, float, float, float]]) -> str:
    values = ", ".join(f"({k}, {c!r}::DOUBLE, {e!r}::DOUBLE, {g!r}::DOUBLE)" for k, c, e, g in points)
    return f"""SELECT *, mae - base mae_change, (mae - base) * 100 / base mae_change_percent FROM (SELECT point, cap_start, max_edit, rate, count(*) n, avg(pr - observed) bias, avg(abs(pr - observed)) mae, sqrt(avg((pr - observed) ** 2)) rmse
        FROM (SELECT *, {_PRICED} pr FROM sr, (VALUES {values}) g(point, cap_start, max_edit, rate)) GROUP BY point, cap_start, max_edit, rate), (SELECT avg(abs(expected - observed)) base FROM sr)"""


CTES |= {
    "sr": """SELECT fixture_id, match_date, home_team_id team_id, 1 is_home, home_score::DOUBLE observed, expected_home expected, home_attack attack, away_defence opponent_defence FROM fe
        UNION ALL SELECT fixture_id, match_date, away_team_id, 0, away_score::DOUBLE, expected_away, away_attack, home_defence FROM fe""",
    "mg": _grid_sql(_GRID), "cg": _grid_sql(_CAPS),
    "mb": "SELECT point, cap_start, max_edit, rate FROM mg ORDER BY round(mae, 9), round(rmse * rmse, 9), round(abs(bias), 9), point LIMIT 1",
}
_TD_BASE |= {"sr": ["fe"], "mg": ["sr"], "cg": ["sr"], "mb": ["mg"]}
_GRID_COLUMNS = "point, n, " + ", ".join(r(c, c) for c in ("cap_start", "max_edit", "rate", "bias", "mae", "rmse", "mae_change", "mae_change_percent"))


@query("m4_curve_grid", sql(f"SELECT {_GRID_COLUMNS} FROM mg", "mg"))
def _(spark, sf):
    return residuals.curve_grid(strength_rows(spark, sf), _GRID).select("point", "cap_start", "max_edit", "rate", "n", "bias", "mae", "rmse", "mae_change", "mae_change_percent")


_FLAGGED = "SELECT *, NOT (observed - expected BETWEEN mu - 1.5 * sd AND mu + 1.5 * sd) outlier FROM sr, (SELECT avg(observed - expected) mu, stddev_samp(observed - expected) sd FROM sr)"


@query("l8_sensitivity", sql(f"SELECT count(d) AS n, {r('avg(d)', 'mean')}, {r('quantile_cont(d, 0.5)', 'median')}, {r('max(d)', 'most')} FROM (SELECT outlier, abs(lead(attack) OVER (PARTITION BY team_id ORDER BY match_date, fixture_id) - attack) d FROM ({_FLAGGED})) WHERE outlier", "sr"))
def _(spark, sf):
    rows = strength_rows(spark, sf).withColumn("residual", F.col("observed") - F.col("expected"))
    return residuals.sensitivity(residuals.flagged(rows), "attack")


@query("m3_score_metrics", sql(" UNION ALL ".join(f"SELECT '{s}' AS sample, count(*) AS n, {r('avg(expected - observed)', 'bias')}, {r('avg(abs(expected - observed))', 'mae')}, {r('corr(expected, observed)', 'correlation')} FROM res WHERE {c}" for s, c in (("home", "is_home = 1"), ("away", "is_home = 0"), ("all", "true"))), "res"))
def _(spark, sf):
    return residuals.score_metrics(residuals.team_residuals(rebuild.expectations(spark, sf)).withColumnRenamed("expected", "predicted")).select("sample", "n", "bias", "mae", "correlation")


# --- reports ------------------------------------------------------------------------------------

_DESC = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'sd')}, {r(f'min({c})', 'least')}, {r(f'max({c})', 'most')}, " + ", ".join(r(f"quantile_cont({c}, {q})", f"p{round(q * 100)}") for q in reports.PERCENTILES) + f", count(*) - count({c}) AS missing, count(*) FILTER ({c} <= 0) AS not_positive FROM fe" for c in ("expected_home", "expected_away"))


@query("n1_describe", sql(_DESC, "fe"))
def _(spark, sf):
    return reports.describe(rebuild.expectations(spark, sf), ["expected_home", "expected_away"])


@query("n2_histogram", sql(" UNION ALL ".join(f"SELECT '{c}' AS name, least(floor(({c} - lo) / ((hi - lo) / 30)) + 1, 30)::INTEGER AS bin, count(*) AS n FROM fe, (SELECT min({c}) lo, max({c}) hi FROM fe) GROUP BY 2" for c in ("expected_home", "expected_away")), "fe"))
def _(spark, sf):
    return reports.histogram(rebuild.expectations(spark, sf), ["expected_home", "expected_away"])


@query("n3_extremes", sql(f"SELECT * FROM (SELECT fixture_id, {r('expected_home - expected_away', 'margin')}, 'high' AS \"end\" FROM fe ORDER BY expected_home - expected_away DESC, fixture_id LIMIT 5) UNION ALL SELECT * FROM (SELECT fixture_id, {r('expected_home - expected_away', 'margin')}, 'low' FROM fe ORDER BY expected_home - expected_away, fixture_id LIMIT 5)", "fe"))
def _(spark, sf):
    rows = rebuild.expectations(spark, sf).select("fixture_id", (F.col("expected_home") - F.col("expected_away")).alias("margin"))
    return reports.extremes(rows, "margin", "fixture_id")


@query("n4_named", sql("SELECT fixture_id, h.s_name AS home_name, a.s_name AS away_name FROM fe LEFT JOIN supplier h ON h.s_suppkey = home_team_id LEFT JOIN supplier a ON a.s_suppkey = away_team_id", "fe"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey team_id", "s_name")
    return reports.named(rebuild.expectations(spark, sf), teams, "s_name").select("fixture_id", "home_name", "away_name")


@query("n5_team_points", sql(f"SELECT team_id, count(*) AS n, {r('avg(x)', 'mean')}, {r('quantile_cont(x, 0.5)', 'median')}, {r('max(x)', 'most')} FROM (SELECT home_team_id team_id, expected_home x FROM fe UNION ALL SELECT away_team_id, expected_away FROM fe) GROUP BY team_id", "fe"))
def _(spark, sf):
    return reports.team_points(rebuild.expectations(spark, sf))


@query("n6_errors", sql(f"SELECT {r('avg(h)', 'home_error')}, {r('avg(abs(h))', 'home_mae')}, {r('avg(a)', 'away_error')}, {r('avg(abs(a))', 'away_mae')}, {r('avg(h - a)', 'margin_error')}, {r('avg(abs(h - a))', 'margin_mae')}, {r('avg(h + a)', 'total_error')}, {r('avg(abs(h + a))', 'total_mae')} FROM (SELECT home_score - expected_home h, away_score - expected_away a FROM fe)", "fe"))
def _(spark, sf):
    return reports.errors(rebuild.expectations(spark, sf))


@query("n8_predicate_view", sql(f"SELECT fixture_id, {r('expected_home + expected_away', 'total')} FROM fe WHERE (home_team_id = 3 OR away_team_id = 3) AND season >= 1995 AND expected_home + expected_away >= 55", "fe"))
def _(spark, sf):
    rows = rebuild.expectations(spark, sf).withColumn("total", F.col("expected_home") + F.col("expected_away"))
    return rows.filter("(home_team_id = 3 OR away_team_id = 3) AND season >= 1995 AND total >= 55").select("fixture_id", "total")


@query("n10_upcoming", sql("SELECT fixture_id, match_date, h.s_name AS home_name, a.s_name AS away_name FROM future JOIN supplier h ON h.s_suppkey = home_team_id JOIN supplier a ON a.s_suppkey = away_team_id WHERE match_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-08'", "future"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey team_id", "s_name")
    week = td.future(spark, sf).filter("match_date BETWEEN DATE'2000-01-01' AND DATE'2000-01-08'")
    return reports.named(week, teams, "s_name").select("fixture_id", "match_date", "home_name", "away_name")


@query("n12_last_results", sql("""SELECT f.fixture_id AS for_fixture, f.team_id, row_number() OVER w AS back, t.fixture_id, t.opponent_id, t.points_for, t.points_against, CASE WHEN t.is_home = 1 THEN 'H' ELSE 'A' END AS place
    FROM (SELECT fixture_id, match_date, home_team_id team_id FROM future UNION ALL SELECT fixture_id, match_date, away_team_id FROM future) f JOIN tm t ON t.team_id = f.team_id AND t.match_date < f.match_date
    WINDOW w AS (PARTITION BY f.fixture_id, f.team_id ORDER BY t.match_date DESC, t.fixture_id DESC) QUALIFY row_number() OVER w <= 3""", "future", "tm"))
def _(spark, sf):
    return reports.last_results(td.future(spark, sf), form.team_matches(td.results(spark, sf)))


@query("n13_display_text", sql("SELECT fixture_id, strftime(match_date, '%d %b') AS day, CASE WHEN day(match_date) IN (11, 12, 13) THEN 'th' WHEN day(match_date) % 10 = 1 THEN 'st' WHEN day(match_date) % 10 = 2 THEN 'nd' WHEN day(match_date) % 10 = 3 THEN 'rd' ELSE 'th' END AS suffix, concat(home_score, '-', away_score) AS score, printf('%+.1f', floor(-(home_score - away_score)::DOUBLE) + 0.5) AS line FROM results", "results"))
def _(spark, sf):
    rows = td.results(spark, sf)
    suffix = F.regexp_extract(fx.ordinal_day(F.col("match_date")), r"\d+([a-z]{2}) ", 1)
    return rows.select("fixture_id", F.date_format("match_date", "dd MMM").alias("day"), suffix.alias("suffix"), F.concat_ws("-", F.col("home_score").cast("string"), F.col("away_score").cast("string")).alias("score"), fx.signed_line((markets.handicap_mainline(F.col("home_score"), F.col("away_score"))).cast("double")).alias("line"))


@query("n14_by_day", sql("SELECT match_date, count(*) AS n, string_agg(fixture_id, ',' ORDER BY fixture_id) AS fixtures FROM future GROUP BY match_date", "future"))
def _(spark, sf):
    return reports.by_day(td.future(spark, sf))


# --- the rest of the inventory --------------------------------------------------------------------


@query("b8_two_teams", "SELECT o_orderkey AS k, CASE WHEN len(d) = 2 THEN d[1] END AS first, CASE WHEN len(d) = 2 THEN d[2] END AS second FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN ['a'] WHEN o_custkey % 3 = 1 THEN ['a', 'b'] ELSE ['b', CAST(o_orderkey % 5 AS VARCHAR), 'c'] END d FROM orders)")
def _(spark, sf):
    links = F.expr("CASE WHEN o_custkey % 3 = 0 THEN array('a', 'a') WHEN o_custkey % 3 = 1 THEN array('a', 'b', 'a') ELSE array('b', cast(o_orderkey % 5 as string), 'c') END")
    pair = season_log.two_teams(links)
    return td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), pair[0].alias("first"), pair[1].alias("second"))


@query("c4_team_ids", sql("""SELECT fixture_id, h.team_id AS home_team_id, a.team_id AS away_team_id FROM (SELECT fixture_id, season, x.s_name hn, y.s_name an FROM matches JOIN supplier x ON x.s_suppkey = home_team_id JOIN supplier y ON y.s_suppkey = away_team_id) m
    LEFT JOIN LATERAL (SELECT arg_max(team_id, coalesce(valid_from, -1) * 10000000 + team_id) team_id FROM team_map t WHERE t.source_team_name = m.hn AND (valid_from IS NULL OR valid_from <= m.season) AND (valid_to IS NULL OR valid_to >= m.season)) h ON true
    LEFT JOIN LATERAL (SELECT arg_max(team_id, coalesce(valid_from, -1) * 10000000 + team_id) team_id FROM team_map t WHERE t.source_team_name = m.an AND (valid_from IS NULL OR valid_from <= m.season) AND (valid_to IS NULL OR valid_to >= m.season)) a ON true""", "matches", "team_map"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey team_id", "s_name")
    rows = reports.named(td.view(spark, sf, "matches"), teams, "s_name").select("fixture_id", "season", "home_name", "away_name")
    return keys.with_team_ids(rows, td.view(spark, sf, "team_map")).select("fixture_id", "home_team_id", "away_team_id")


@query("c5_stages", sql("""SELECT 1 AS competition_stage_id, 1 AS tournament_id, 'super_8s' AS stage UNION ALL
    SELECT 1 + row_number() OVER (ORDER BY season, t, stage), t, stage FROM (SELECT season % 2 t, stage, min(season) season FROM kept GROUP BY ALL HAVING NOT (t = 1 AND stage = 'super_8s'))""".replace("SELECT season % 2 t, stage, min(season) season FROM kept GROUP BY ALL HAVING NOT (t = 1 AND stage = 'super_8s')", "SELECT t, stage, min(season) season FROM (SELECT season % 2 t, stage, season FROM kept) WHERE NOT (t = 1 AND stage = 'super_8s') GROUP BY t, stage"), "kept"))
def _(spark, sf):
    known = spark.sql("SELECT 1L competition_stage_id, 1 tournament_id, 'super_8s' stage")
    rows = season_log.scored(season_log.dated(season_log.staged(td.view(spark, sf, "season_log"))), 2023)
    return keys.stages(rows.withColumn("tournament_id", (F.col("season") % 2).cast("int")), known)


@query("c6_one_tournament", sql("SELECT season, count(DISTINCT home_team_id % (1 + season % 2)) AS n FROM matches GROUP BY season HAVING count(DISTINCT home_team_id % (1 + season % 2)) <> 1", "matches"))
def _(spark, sf):
    return keys.one_tournament(td.view(spark, sf, "matches").withColumn("tournament", F.col("home_team_id") % (1 + F.col("season") % 2)))


@query("h4_matrix_versions", sql("SELECT 'v1' AS matrix_version, CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score, count(*) AS n FROM results GROUP BY ALL", "results"))
def _(spark, sf):
    path = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    cells = td.results(spark, sf).groupBy("home_score", "away_score").agg(F.count("*").alias("n"))
    steps = ((2, 1.0), (4, 0.5), (6, 0.25), (999, 0.10))
    upsert.write_matrix(cells.withColumn("n", F.col("n") + 1), path, "v1", "1999-01-01", steps)
    for k in (1, 0):  # the second write of a date replaces the first
        upsert.write_matrix(cells.withColumn("n", F.col("n") + k), path, "v1", "2000-01-01", steps)
    newest = upsert.latest_versions(spark.read.parquet(f"{path}/cells"))
    return newest.select("matrix_version", "home_score", "away_score", "n")


@query("h10_blended_matrix", sql(f"SELECT season, {r('sum(p)', 'mass')}, {r('sum(home_score * p)', 'home_mean', 4)}, {r('sum(away_score * p)', 'away_mean', 4)} FROM (SELECT season, home_score, away_score, 0.2 * w / sum(w) OVER (PARTITION BY season) p FROM sh UNION ALL SELECT season, i.k, j.k, 0.8 * exp(-th + i.k * ln(th) - lgamma(i.k + 1)) * exp(-ta + j.k * ln(ta) - lgamma(j.k + 1)) FROM targets, range(0, 101) i(k), range(0, 101) j(k)) GROUP BY season", "sh"))
def _(spark, sf):
    targets = written(_targets(spark, sf), "targets")
    both = distributions.blended(distributions.poisson_cells(targets, ["season"], "th", "ta"), distributions.shifted(td.results(spark, sf), targets, ["season"], "th", "ta"), ["season"], 0.2)
    means = distributions.implied_means(both, ["season"]).withColumns({c: F.round(c, 4) for c in ("home_mean", "away_mean")})
    return both.groupBy("season").agg(F.sum("p").alias("mass")).join(means, "season")


@query("k9_season_weights", sql(_best("season,"), "ls"))
def _(spark, sf):
    return backtest.best(backtest.summary(_swept(spark, sf), ["season", "weight"]), ["season"])


@query("k11_model_comparison", sql("SELECT fixture_id, CASE weight WHEN 0 THEN 'poisson' WHEN 100 THEN 'history' ELSE 'blend' END AS model, " + r("s", "p_score") + ", " + ", ".join(r(f"1 / {c}", f"price_{n}", 4) for n, c in (("home", "h"), ("draw", "d"), ("away", "a"))) + ", " + r("hm", "home_mean") + ", " + r("am", "away_mean") + " FROM sw WHERE weight IN (0, 20, 100)", "sw"))
def _(spark, sf):
    return backtest.model_comparison(_both_models(spark, sf)).withColumns({f"price_{c}": F.round(f"price_{c}", 4) for c in ("home", "draw", "away")})


@query("k12_final_weights", sql(f"SELECT weight, {_SUMMARY} FROM ls WHERE weight IN (0, 70, 80, 100) GROUP BY weight", "ls"))
def _(spark, sf):
    return backtest.swept_summary(_both_models(spark, sf), "poisson", "hist", (0, 70, 80, 100))


@query("l4_recent_ratio", sql(f"SELECT fixture_id, team_id, {', '.join(r(f'p_{m}', f'predicted_{m}') for m in residuals.METHODS)} FROM pred", "pred"))
def _(spark, sf):
    rows = _recent_ratios(spark, sf)
    return rows.select("fixture_id", "team_id", *[f"predicted_{m}" for m in residuals.METHODS])


@query("l6_gain_on_raw", sql("SELECT method, " + r("(SELECT mae FROM b WHERE method = 'raw') - mae", "gain") + " FROM b", "pred").replace("\nSELECT method, ", ",\nb AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, avg(abs(p_{m} - observed)) mae FROM pred WHERE p_{m} IS NOT NULL" for m in residuals.METHODS) + ")\nSELECT method, "))
def _(spark, sf):
    return residuals.leaderboard(_recent_ratios(spark, sf)).select("method", "gain")


@query("l11_cap_grid", sql(f"SELECT {_GRID_COLUMNS} FROM cg", "cg"))
def _(spark, sf):
    return residuals.curve_grid(strength_rows(spark, sf), _CAPS).select("point", "cap_start", "max_edit", "rate", "n", "bias", "mae", "rmse", "mae_change", "mae_change_percent")


@query("m1_multipliers", sql(f"SELECT fixture_id, {r('max(CASE WHEN is_home = 1 THEN ra END)', 'home_attack')}, {r('max(CASE WHEN is_home = 0 THEN rd END)', 'away_defence')} FROM raw GROUP BY fixture_id", "raw"))
def _(spark, sf):
    results = td.results(spark, sf)
    rows = strength.raw_multipliers(strength.league_average(form.recent_form(form.team_matches(results), (5,)))).withColumnsRenamed({"raw_attack": "attack", "raw_defence": "defence"})
    return residuals.with_multipliers(results.select("fixture_id"), rows).select("fixture_id", "home_attack", "away_defence")


_SIDE = {c: (e.format(p="expected"), e.format(p="pr")) for c, e in {"bias": "avg({p} - observed)", "mae": "avg(abs({p} - observed))", "rmse": "sqrt(avg(({p} - observed) ** 2))", "correlation": "corr({p}, observed)"}.items()}
_SIDES = ", ".join(f"{r(b, f'base_{c}')}, {r(p, f'curved_{c}')}, {r(f'{p} - {b}', f'{c}_change')}" for c, (b, p) in _SIDE.items())


@query("m5_best_curve", sql(f"SELECT unnest([CASE WHEN is_home = 1 THEN 'home' ELSE 'away' END, 'all']) AS sample, * FROM (SELECT *, {_PRICED} pr FROM sr, mb)", "sr", "mb").replace("SELECT unnest(", f"SELECT sample, count(*) AS n, {_SIDES}, point, {r('cap_start', 'cap_start')}, {r('max_edit', 'max_edit')}, {r('rate', 'rate')} FROM (SELECT unnest(") + ") GROUP BY sample, point, cap_start, max_edit, rate")
def _(spark, sf):
    return residuals.best_curve(strength_rows(spark, sf), _GRID)


@query("n7_largest_misses", sql(" UNION ALL ".join(f"SELECT * FROM (SELECT fixture_id, {r('t', 'total_error')}, {r('m', 'margin_error')}, '{n}' AS \"by\" FROM (SELECT fixture_id, home_score - expected_home + away_score - expected_away t, home_score - expected_home - away_score + expected_away m FROM fe) ORDER BY round(abs({c}), 9) DESC, fixture_id LIMIT 5)" for n, c in (("total_error", "t"), ("margin_error", "m"))), "fe"))
def _(spark, sf):
    return reports.largest_misses(rebuild.expectations(spark, sf))


@query("n9_prediction_report", sql("SELECT fixture_id, match_date, h.s_name AS home_name, a.s_name AS away_name, round(expected_home, 2) + 0.0 AS expected_home, round(expected_away, 2) + 0.0 AS expected_away FROM fe JOIN supplier h ON h.s_suppkey = home_team_id JOIN supplier a ON a.s_suppkey = away_team_id", "fe"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey team_id", "s_name")
    rows = reports.named(rebuild.expectations(spark, sf), teams, "s_name")
    return rows.select("fixture_id", "match_date", "home_name", "away_name", *[F.round(f"expected_{s}", 2).alias(f"expected_{s}") for s in ("home", "away")])


@query("n11_details", sql("SELECT fixture_id, h.s_name AS home_name, a.s_name AS away_name FROM results JOIN supplier h ON h.s_suppkey = home_team_id JOIN supplier a ON a.s_suppkey = away_team_id UNION ALL SELECT fixture_id, NULL, NULL FROM future", "results", "future"))
def _(spark, sf):
    teams = td.table(spark, sf, "supplier").selectExpr("s_suppkey team_id", "s_name")
    ids = td.view(spark, sf, "matches")
    found, lost = reports.details(ids, td.results(spark, sf), teams, "s_name")
    return found.select("fixture_id", "home_name", "away_name").unionByName(lost, allowMissingColumns=True)


from oddsmill.plans import steps  # noqa: E402, F401  its queries join these
