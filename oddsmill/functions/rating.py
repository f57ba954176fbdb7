"""Column functions of ratings and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shrunk(observed: Column, games: Column, league: Column, prior_games: float) -> Column:
    """Observed mean drawn to the league mean; a missing mean is the league's, missing games are none."""
    n = F.coalesce(games, F.lit(0))
    return (F.coalesce(observed, league) * n + league * prior_games) / (n + prior_games)


def capped_curve(x: Column, cap_start: Column | float = 0.75, max_edit: Column | float = 0.40, rate: Column | float = 0.80) -> Column:
    """Smooth approach to 1 +- max_edit; flat once the edited distance from 1 reaches cap_start."""
    edit = (x - 1.0) * rate
    reach = F.least(F.abs(edit) / cap_start, F.lit(1.0))
    return 1.0 + F.signum(edit) * max_edit * (2.0 * reach - reach * reach)


def age_years(as_of: Column, day: Column) -> Column:
    return F.datediff(as_of, day) / F.lit(365.25).cast("double")


def step_weight(years: Column, steps: tuple[tuple[float, float], ...] = ((2, 1.0), (4, 0.5), (6, 0.25), (999, 0.10))) -> Column:
    """Weight by age; dates in the future count as new."""
    out = None
    for most, weight in steps:
        out = F.when(years <= most, F.lit(weight)) if out is None else out.when(years <= most, F.lit(weight))
    return out.otherwise(F.lit(0.0))


def decay_weight(years: Column) -> Column:
    """1 to two years, 0.5 to four, then halving every two years."""
    age = F.greatest(years, F.lit(0.0))
    return F.when(age <= 2, 1.0).when(age <= 4, 0.5).otherwise(0.5 * F.pow(F.lit(0.5), (age - 4.0) / 2.0))


def price(p: Column) -> Column:
    """Fair decimal price; no chance costs infinity."""
    return F.when(p > 0, F.lit(1.0) / p).otherwise(F.lit(float("inf")))


def clipped(p: Column, edge: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(edge)), F.lit(1.0 - edge))


def binary_loss(p: Column, hit: Column) -> Column:
    return -F.when(hit, F.log(clipped(p))).otherwise(F.log(1.0 - clipped(p)))


def stage_of(heading: Column) -> Column:
    """Competition stage of a section heading, NULL for other competitions."""
    h = F.lower(F.trim(F.regexp_replace(heading, r"\s+", " ")))
    # Headings of the source and the stages they stand for.
    other = ("challenge cup", "world club challenge", "world club series", "million pound game", "kiwis tour")
    out = F.when(h.contains("qualifier") & ~h.contains("qualif playoff"), None)
    for words in other:
        out = out.when(h.contains(words), None)
    out = out.when(h.startswith("s8 round"), "super_8s").when(h.contains("grand final"), "grand_final").when(h == "quarter final", "quarter_final")
    out = out.when(h.isin("semi final", "prelim semi", "qualif semi"), "semi_final").when(h == "prelim final", "preliminary_final")
    return out.when(h == "elim", "elimination_final").when(h == "qualif playoff", "playoff").when(h.startswith("round "), "regular_season")


def whole_number(text: Column) -> Column:
    """Integer from text with thousands commas; anything else is NULL."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("int")


def player_key(source_id: Column, name: Column) -> Column:
    squeezed = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.coalesce(F.concat(F.lit("rlp_"), F.nullif(source_id, F.lit(""))), F.concat(F.lit("rlp_name:"), F.substring(F.sha1(squeezed.cast("binary")), 1, 16)))


def player_name(text: Column) -> Column:
    """Squeezed, without a captain's mark at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?i)\s+\(c\)$", "")


def last_segment(href: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(href, "/+$", ""), "/"), -1)


def match_number(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"^/matches/(\d+)$", 1), F.lit(""))


def fixture_key(day: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("_", F.date_format(day, "yyyy-MM-dd"), home.cast("string"), away.cast("string"))


def ordinal_day(day: Column) -> Column:
    d = F.dayofmonth(day)
    suffix = F.when(d.isin(11, 12, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(day, "EEEE "), d.cast("string"), suffix, F.date_format(day, " MMMM"))


def signed_line(line: Column) -> Column:
    return F.format_string("%+.1f", line)


def missing(x: Column) -> Column:
    """NaN as NULL: averages must skip it."""
    return F.when(~F.isnan(x), x)
