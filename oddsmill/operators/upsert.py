"""Keyed upserts as join and rewrite: a new snapshot, never the path that is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.sources.tables import KEYS, columns

#: Columns that an upsert of a known key may change. Results keep season, date, teams and source name; the others change whatever is no key.
UPDATED: dict[str, list[str]] = {
    name: [c for c in columns(name) if c not in KEYS[name]] for name in ("tournament_source_mappings", "fixtures", "players", "teamsheets", "expected_score_predictions")
} | {"results": ["kick_off", "home_score", "away_score", "referee", "venue", "attendance", "source_match_id"]}


def last_of_batch(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of one key apply in order, so the last stays."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return batch.withColumn("_n", nth).filter("_n = 1").drop("_n")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str, update: list[str] | None = None, stamp: str | None = None, now: str | None = None) -> DataFrame:
    """The snapshot after the batch: new keys come in, known keys change in ``update`` (default all others)."""
    unknown = [c for c in batch.columns if c not in target.columns and c != order]
    lost = [c for c in keys if c not in batch.columns]
    if unknown or lost:
        raise ValueError(f"unknown columns {unknown}, missing keys {lost}")
    src = last_of_batch(batch, keys, order).drop(order).withColumn("_src", F.lit(True)).alias("s")
    old = target.withColumn("_old", F.lit(True)).alias("t")
    both = old.join(src, keys, "full_outer")
    change = set(update if update is not None else [c for c in target.columns if c not in keys])
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == stamp and now is not None:
            out.append(F.when(F.col("_src"), F.lit(now).cast("timestamp")).otherwise(F.col(f"t.{c}")).alias(c))
        elif c not in batch.columns:
            out.append(F.col(f"t.{c}").alias(c) if c in target.columns else F.lit(None).alias(c))
        elif c in change:
            out.append(F.when(F.col("_src"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return both.select(*out)


def upsert_table(name: str, target: DataFrame, batch: DataFrame, order: str, now: str | None = None) -> DataFrame:
    """``upsert`` into a declared table by its key and its list of columns; ``updated_at`` becomes ``now`` in all rows of the batch."""
    return upsert(target, batch, KEYS[name], order, UPDATED[name], "updated_at" if "updated_at" in target.columns else None, now)


def write_seasons(df: DataFrame, path: str) -> None:
    """Replace the seasons that ``df`` has and no others, in one job."""
    df.write.partitionBy("season").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def latest_versions(matrices: DataFrame) -> DataFrame:
    """Rows of the newest ``as_of_date`` of each version."""
    newest = matrices.groupBy("matrix_version").agg(F.max("as_of_date").alias("as_of_date"))
    return matrices.join(newest, ["matrix_version", "as_of_date"])


def write_matrix(cells: DataFrame, path: str, version: str, as_of: str, weights: tuple[tuple[float, float], ...]) -> None:
    """Cells of one version and date, replacing them alone, with a row of metadata that records the weights."""
    stamped = cells.withColumns({"matrix_version": F.lit(version), "as_of_date": F.lit(as_of).cast("date")})


    def written(df: DataFrame, name: str) -> None:
        df.write.partitionBy("matrix_version", "as_of_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")

    written(stamped, "cells")
    config = F.to_json(F.array(*[F.struct(F.lit(int(a)).alias("max_age"), F.lit(float(w)).alias("weight")) for a, w in weights]))
    about = cells.agg(F.count("*").alias("cells")).select(F.lit(version).alias("matrix_version"), F.lit(as_of).cast("date").alias("as_of_date"), "cells", config.alias("weight_config"))
    written(about, "about")


def load_parquet(target: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``target`` after the upsert of a Parquet batch; a key that occurs on several rows counts once."""
    batch = target.sparkSession.read.parquet(path).withColumn("batch_seq", F.lit(1))
    return upsert(target, batch, keys, "batch_seq")
