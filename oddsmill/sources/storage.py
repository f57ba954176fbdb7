"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in a local session where that is not set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(sc, "_oddsmill_work"):
        sc._oddsmill_work = tempfile.mkdtemp(prefix="oddsmill-")
        sc.setCheckpointDir(sc._oddsmill_work)
    return sc._oddsmill_work


def written(df: DataFrame, name: str, before: DataFrame | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts the lineage and outlives executors.

    ``before`` is a written table that ``df`` took the place of: it is deleted once ``df`` is there.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _saved(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if before is not None:
        discard(before)
    return out


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _saved(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def resting_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads these written tables: they may go with it."""
    df._rests_on = tables
    return df


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` made and no plan reads any more, or the written tables that ``resting_on`` named."""
    spark, path = table.sparkSession, getattr(table, "_written_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for other in getattr(table, "_rests_on", ()):
        discard(other)


def files_digest(*sources: DataFrame) -> str:
    """Count and sum of hashes of path, size and time of change of all files that the tables are read from."""
    columns = [F.col(f"_metadata.file_{c}").alias(c) for c in ("path", "size", "modification_time")]
    files = reduce(DataFrame.unionByName, [s.select(*columns).distinct() for s in sources])
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h}"


def kept(name: str, sources: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written once an application for the same files of ``sources``.

    ``name`` tells tables of the same sources apart, parameters included.  If a file of the
    sources has changed, or the written table is gone, it is made again.  Tables that what
    ``make`` gives rests on (``resting_on``) go once it is written.
    """
    spark = sources[0].sparkSession
    key = (spark.sparkContext.applicationId, name, files_digest(*sources))
    known = _KEPT.get(key)
    if known is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{known._written_at}/_SUCCESS")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(known.schema).parquet(known._written_at)
    made = make()
    _KEPT[key] = written(made, name.split("|")[0], made)
    return _KEPT[key]


#: Written tables by application, name and files of the sources.
_KEPT: dict[tuple[str, str, str], DataFrame] = {}
