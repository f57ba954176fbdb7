"""Connected components by alternating large-star and small-star.

Every round is a grouping and a join on the edges, written to the shared folder;
nothing is collected.  Hubs are met by partial aggregation and by Spark's skew
joins: both inputs of each join are read from written tables, so that the partition
of a hub can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise, replaced


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars: each ``u`` has one ``v``, and no ``v`` is a ``u`` of another edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0)))).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above ``u`` is linked to the least of ``u`` and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``u`` and its neighbours below are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    links = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``edges`` (u, v)."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    # Stars are the fixed point: to look for them spares the round that would change nothing.
    while not _settled(edges):
        edges = replaced(_large_star(edges).filter("u <> v").distinct(), "edges", edges)
        edges = replaced(_small_star(edges).filter("u <> v").distinct(), "edges", edges)
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
