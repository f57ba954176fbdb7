"""Row windows over a whole table without moving it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.sources.storage import resting_on, written


def row_numbers(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``_i``: the place of each row in the order, from 0. Ranges are sorted apart; only their counts meet."""
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("_i", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")
    return resting_on(numbered, dealt)


def trailing_mean(df: DataFrame, order: list[str], value: str, rows: int, out: str, bucket: int | None = None, parts: int | None = None, place: str | None = None) -> DataFrame:
    """Mean of ``value`` over the ``rows`` rows before each one in the order of the whole table.

    Rows are numbered, cut into buckets of many times ``rows``, and the last ``rows`` of a
    bucket are repeated at the head of the next one.  ``place`` names a column for the number of a row.
    """
    bucket = bucket or max(50_000, 20 * rows)
    numbered = row_numbers(df, order, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    home = F.floor(F.col("_i") / bucket)
    late = F.col("_i") % bucket >= bucket - rows
    spread = numbered.withColumn("_b", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
    before = Window.partitionBy("_b").orderBy("_i").rowsBetween(-rows, -1)
    means = spread.withColumn(out, F.avg(value).over(before)).filter(F.col("_b") == home).drop("_b")
    return resting_on(means.withColumnRenamed("_i", place) if place else means.drop("_i"), numbered)
