"""Headings, months, lineups, keys and upserts on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import rating as fx
from oddsmill.operators import backtest, keys, lineups, reports, season_log, upsert
from oddsmill.sources import tables


@pytest.mark.parametrize(("heading", "stage"), [("Round 12", "regular_season"), (" S8  Round 3", "super_8s"), ("Grand Final", "grand_final"), ("Challenge Cup Semi Final", None), ("Qualifiers R1", None), ("Qualif Playoff", "playoff"), ("Prelim Semi", "semi_final"), ("Elim", "elimination_final"), ("Prelim Final", "preliminary_final"), ("Million Pound Game", None), ("Notes", None)])
def test_stages(spark, heading, stage):
    assert spark.createDataFrame([(heading,)], "h string").select(fx.stage_of(F.col("h")).alias("s")).first().s == stage


def log(spark, rows):
    return spark.createDataFrame(rows, "season int, row_idx int, n_cells int, heading string, other_link boolean, league_link boolean, date_txt string, home_score_txt string, away_score_txt string, attendance_txt string, source_match_id string")


def test_season_log(spark):
    head = lambda i, h, other=False, league=False: (2020, i, 1, h, other, league, None, None, None, None, None)
    match = lambda i, d, h, a, m: (2020, i, 10, None, False, False, d, h, a, "1,234", m)
    rows = [
        match(0, "Jan 1", "1", "2", "m0"), head(1, "Round 1"), match(2, "Feb 3", "10", "12", "m1"), match(3, "5", "8", "", "m2"), match(4, "6", "4", "4", "m1"), match(5, "31", "1", "1", "m3"),
        head(6, "Cup", other=True), match(7, "Mar 9", "1", "1", "m4"), head(8, "Semi Final"), match(9, "10", "3", "5", None), match(10, "x Apr 1", "3", "5", "m5"), head(11, "League news", league=True), match(12, "11", "1", "1", "m6"),
    ]
    got = [(r.row_idx, r.stage, str(r.match_date), r.home_score, r.attendance) for r in season_log.matches(log(spark, rows), 2023).orderBy("row_idx").collect()]
    assert got == [(2, "regular_season", "2020-02-03", 10, 1234), (9, "semi_final", "2020-02-10", 3, 1234)]


def test_lineups(spark):
    rows = [(1, 0, "WG", "early", "early", None), (1, 1, "FB", "A (c)", "B", "7")] + [(1, k, f"P{k}", f"h{k}", f"a{k}" if k != 5 else None, None) for k in range(2, 20)] + [(1, 30, "HC", "coach", "coach", None), (2, 1, "FB", "x", "y", None), (3, 1, "WG", "x", "y", None)]
    df = spark.createDataFrame(rows, "match_id long, row_idx int, position string, home_name string, away_name string, source_player_id string")
    got = lineups.lineups(df).collect()
    home, away = ([r for r in got if r.side == s] for s in ("home", "away"))
    assert len(home) == len(away) == 17 and min(home, key=lambda r: r.lineup_order).player_name == "A"
    assert max(r.lineup_order for r in home) == 17 and max(r.lineup_order for r in away) == 18
    assert sum(r.is_starting for r in away) == 12
    assert {r.match_id for r in lineups.rejected(df).collect()} == {2, 3}


def test_player_keys(spark):
    rows = spark.createDataFrame([("12", "x"), ("", " Jo  Bloggs"), (None, "jo bloggs")], "i string, n string").select(fx.player_key(F.col("i"), F.col("n")).alias("k")).collect()
    assert rows[0].k == "rlp_12" and rows[1].k == rows[2].k and rows[1].k.startswith("rlp_name:") and len(rows[1].k) == 25


def test_names_ids_and_numbers(spark):
    row = spark.createDataFrame([("Leigh Centurions", "/teams/leeds/", "/matches/99", "1,203", "x")], "n string, t string, m string, a string, b string").select(
        keys.canonical_name(F.col("n")).alias("n"), fx.last_segment(F.col("t")).alias("t"), fx.match_number(F.col("m")).alias("m"), fx.whole_number(F.col("a")).alias("a"), fx.whole_number(F.col("b")).alias("b"))
    assert tuple(row.first()) == ("Leigh Leopards", "leeds", "99", 1203, None)


def test_mapping_validity(spark):
    maps = spark.createDataFrame([(1, "X", None, 1999), (2, "X", 1998, None), (3, "Y", 2005, None)], "team_id long, source_team_name string, valid_from int, valid_to int")
    asked = spark.createDataFrame([("X", 1990), ("X", 1998), ("X", 2000), ("Y", 2000), ("Z", 2000)], "source_team_name string, season int")
    assert {(r.source_team_name, r.season): r.team_id for r in keys.valid_mapping(asked, maps).collect()} == {("X", 1990): 1, ("X", 1998): 2, ("X", 2000): 2, ("Y", 2000): None, ("Z", 2000): None}


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    batch = spark.createDataFrame([(2, "c", "z", 1), (2, "d", "q", 2), (3, "e", "r", 1)], "k int, v string, w string, n int")
    assert sorted(tuple(r) for r in upsert.upsert(target, batch, ["k"], "n").collect()) == [(1, "a", "x"), (2, "d", "q"), (3, "e", "r")]
    assert sorted(tuple(r) for r in upsert.upsert(target, batch, ["k"], "n", update=["v"]).collect()) == [(1, "a", "x"), (2, "d", "y"), (3, "e", "r")]
    assert upsert.upsert(target, batch.filter("k > 9"), ["k"], "n").count() == 2
    with pytest.raises(ValueError):
        upsert.upsert(target, batch.withColumnRenamed("v", "unknown"), ["k"], "n")


def test_csv_and_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Unnamed: 0,year,date,home_team,away_team,home_score,away_score\n0,2020,2020-01-02,A,B,1,2\n1,2020,2020-01-03,A,,1,2\n")
    assert [tuple(r)[2:] for r in tables.read_results_csv(spark, str(tmp_path / "r.csv")).collect()] == [("A", "B", 1, 2)]
    df = spark.createDataFrame([(1, 2.0)], "fixture_id int, home_expected double")
    assert tables.canonical(df, {"expected_home": ["expected_home", "home_expected"]}).columns == ["fixture_id", "expected_home"]
    with pytest.raises(ValueError):
        tables.first_column(df, ["nope"])


def test_schemas_parse(spark):
    for name, ddl in tables.SCHEMAS.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_bootstrap_is_near_the_mean_and_repeats(spark):
    rows = spark.range(400).selectExpr("cast(id as string) fixture_id", "explode(array(0, 70)) weight", "id % 7 base").selectExpr("fixture_id", "weight", "base + weight / 100.0D x")
    a, b = (backtest.bootstrap(rows, ("x",), (70,), samples=300).first() for _ in range(2))
    assert a == b and a["mean"] == pytest.approx(0.7) and a["low"] <= 0.7 + 1e-9 <= a["high"] + 1e-8


def test_last_results_are_strictly_before(spark):
    import datetime as dt

    games = spark.createDataFrame([(f"g{k}", dt.date(2020, 1, k), 1, 2, k % 2, k, 0) for k in range(1, 6)], "fixture_id string, match_date date, team_id long, opponent_id long, is_home int, points_for int, points_against int")
    asked = spark.createDataFrame([("f", dt.date(2020, 1, 5), 1, 9)], "fixture_id string, match_date date, home_team_id long, away_team_id long")
    got = {r.back: (r.fixture_id, r.place) for r in reports.last_results(asked, games).collect()}
    assert got == {1: ("g4", "A"), 2: ("g3", "H"), 3: ("g2", "A")}


def test_histogram_and_ordinals(spark):
    got = {r.bin: r.n for r in reports.histogram(spark.createDataFrame([(float(k),) for k in range(11)], "x double"), ["x"], 10).collect()}
    assert got == {**dict.fromkeys(range(1, 10), 1), 10: 2}
    days = spark.createDataFrame([("2026-05-01",), ("2026-05-12",), ("2026-05-23",)], "d string").select(fx.ordinal_day(F.to_date("d")).alias("t"), fx.signed_line(F.lit(-6.5)).alias("s"))
    assert [tuple(r) for r in days.collect()] == [("Friday 1st May", "-6.5"), ("Tuesday 12th May", "-6.5"), ("Saturday 23rd May", "-6.5")]
