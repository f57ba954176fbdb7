"""Raw season logs to matches: headings, months, scores, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import stage_of, whole_number

MATCH_CELLS = 10


def staged(log: DataFrame) -> DataFrame:
    """Match rows with the stage of the heading above them; rows under another competition go.

    A heading sets the stage, to NULL too: the carried value is a struct, so that a set
    NULL is not skipped as a missing one.
    """
    stage = F.when(~F.col("other_link"), stage_of(F.col("heading")))
    sets = (F.col("n_cells") != MATCH_CELLS) & (F.col("other_link") | F.col("league_link") | stage.isNotNull())
    carried = F.last(F.when(sets, F.struct(stage.alias("stage"))), ignorenulls=True).over(Window.partitionBy("season").orderBy("row_idx"))
    return log.withColumn("stage", carried["stage"]).filter((F.col("n_cells") == MATCH_CELLS) & F.col("stage").isNotNull())


def dated(rows: DataFrame) -> DataFrame:
    """Dates from days and the month last printed in the rows that are left; others go."""
    text = F.trim("date_txt")
    alpha = text.rlike(r"\p{L}")
    parts = F.split(text, r"\s+")
    named = alpha & (F.size(parts) == 2)
    rows = rows.filter(~alpha | named)
    month = F.last(F.when(named, parts[0]), ignorenulls=True).over(Window.partitionBy("season").orderBy("row_idx"))
    day = F.when(named, parts[1]).otherwise(text)
    whole = F.concat_ws(" ", month, day, F.col("season").cast("string"))
    date = F.when(month.isNotNull(), F.try_to_timestamp(whole, F.lit("MMM d yyyy")).cast("date"))
    return rows.withColumn("match_date", date).filter("match_date IS NOT NULL")


def scored(rows: DataFrame, this_year: int) -> DataFrame:
    """Both scores or none; none only in seasons that are not over."""
    rows = rows.withColumns({"home_score": whole_number(F.col("home_score_txt")), "away_score": whole_number(F.col("away_score_txt")), "attendance": whole_number(F.col("attendance_txt"))})
    return rows.filter(F.col("home_score").isNull() == F.col("away_score").isNull()).filter(~((F.col("season") < this_year) & F.col("home_score").isNull()))


def first_of_id(rows: DataFrame) -> DataFrame:
    """The first row of each source id in a season; rows without an id all stay."""
    nth = F.row_number().over(Window.partitionBy("season", "source_match_id").orderBy("row_idx"))
    return rows.withColumn("_n", nth).filter((F.col("_n") == 1) | F.col("source_match_id").isNull()).drop("_n")


def matches(log: DataFrame, this_year: int) -> DataFrame:
    """The log's matches in their order: stage, date, scores, attendance, source id."""
    return first_of_id(scored(dated(staged(log)), this_year)).select("season", "row_idx", "stage", "match_date", "home_score", "away_score", "attendance", "source_match_id")


def played(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["home_score", "away_score"])


def headings(log: DataFrame) -> DataFrame:
    """Every heading text with its stage and how often it occurs."""
    return log.filter(F.col("n_cells") != MATCH_CELLS).groupBy("heading", stage_of(F.col("heading")).alias("stage"), "league_link", "other_link").agg(F.count("*").alias("n"))


def two_teams(links: Column) -> Column:
    """The two distinct (slug, name) links of a row, else NULL."""
    distinct = F.array_distinct(links)
    return F.when(F.size(distinct) == 2, distinct)
