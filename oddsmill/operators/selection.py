"""Exact percentiles of a whole column without its distinct values in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Different values of a bin that are ordered in one task; a bin with more is cut again.
MOST = 100_000


def _values_at(rows: DataFrame, ranks: list[int], low: float, high: float, before: int, bins: int, most: int) -> dict[int, float]:
    """The values of the given ranks (from 0), all of which lie in ``rows``: column v from ``low`` to ``high``, ``before`` smaller ones elsewhere."""
    width = (high - low) / bins
    # Rows are counted, not their different values, as grouping these would shuffle the column; equal ones end in a range of no width.
    if width <= 0 or low + width == low or rows.limit(most + 1).count() <= most:
        found, seen = {}, before
        for r in rows.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect():  # at most ``most`` values, or equal ones
            for k in ranks:
                if seen <= k < seen + r.n:
                    found[k] = r.v
            seen += r.n
        return found
    place = F.least(F.floor((F.col("v") - low) / width).cast("int"), F.lit(bins - 1))
    held = rows.withColumn("bin", place)
    table = held.groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()  # at most ``bins`` rows
    out: dict[int, float] = {}
    seen = before
    for r in table:
        own = [k for k in ranks if seen <= k < seen + r.n]
        if own:
            out |= _values_at(held.filter(F.col("bin") == r.bin).select("v"), own, r.low, r.high, seen, bins, most)
        seen += r.n
    return out


def percentiles(df: DataFrame, column: str, shares: list[float], bins: int = BINS, most: int = MOST) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbouring ranks; NULL and NaN do not count.

    One pass counts the rows of ranges of equal width; only ranges that hold an asked rank are
    read on, cut again while they hold many different values, and their values are ordered
    by count.  What reaches the driver is a histogram or the values of one range.
    """
    v = F.col(column).cast("double")
    rows = df.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    size = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not size.n:
        return [None] * len(shares)
    spots = [(size.n - 1) * s for s in shares]
    ranks = sorted({k for x in spots for k in (int(x), min(int(x) + 1, size.n - 1))})
    at = _values_at(rows, ranks, size.low, size.high, 0, bins, most)
    out = []
    for x in spots:
        k, part = int(x), x - int(x)
        low, high = at[k], at[min(k + 1, size.n - 1)]
        out.append(low if part == 0 or low == high else low * (1 - part) + high * part)
    return out
