"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session without that setting (tests) a temporary folder is made
    and set as the checkpoint directory; on a cluster the setting must be there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = getattr(sc, "_oddsmill_shared", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="oddsmill-")
        sc.setCheckpointDir(known)
        sc._oddsmill_shared = known
    return known


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, {})[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Paths of the written tables of each application that are still there.
_WRITTEN: dict[str, dict[str, None]] = {}


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a written table that no plan reads any more."""
    if _WRITTEN.get(spark.sparkContext.applicationId, {}).pop(path, 0) is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def replaced(df: DataFrame, name: str, before: DataFrame) -> DataFrame:
    """``materialise``, then delete the written table ``before`` that ``df`` took the place of."""
    out = materialise(df, name)
    discard(df.sparkSession, getattr(before, "_written_at", None))
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, tables may be written; at the end those that were not handed to the given function are deleted."""
    known, kept = set(_WRITTEN.get(spark.sparkContext.applicationId, {})), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_at)
        return df

    yield keep
    for path in set(_WRITTEN.get(spark.sparkContext.applicationId, {})) - known - kept:
        discard(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_id() -> Column:
    """``doc_id``; a row without one is named by a hash of its text."""
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one, a null ``doc_id`` as the hash of its text."""
    return docs.select(row_id().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def clashing(rows: DataFrame, *what: str) -> DataFrame:
    """The ``doc_id`` that stand for more than one value of ``what`` in ``rows``, as a written table."""
    seen = rows.select("doc_id", F.xxhash64(*what).alias("t")).groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return materialise(seen.filter("lo < hi").select("doc_id"), "clashing")


def told_apart(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text, own, row``: the rows of ``docs`` by names that stand for one text each.

    A row whose ``row_id`` is in ``ids`` is named by a hash of it and the text, any other by
    its ``row_id``; ``own`` is the ``row_id``, ``row`` has all columns.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda rows, name: rows.select(name.alias("doc_id"), text.alias("text"), row_id().alias("own"), F.struct(*docs.columns).alias("row"))
    one, many = parted(docs, ids)
    return materialise(named(one, row_id()).unionByName(named(many, F.xxhash64(row_id(), text))), "apart")


def owned(found: DataFrame, apart: DataFrame, group: str) -> DataFrame:
    """``found`` (doc_id, group, ...) over the rows ``apart``, with ``own`` and the first (own, doc_id) of the group in ``first``."""
    own = materialise(apart.select("doc_id", "own").distinct(), "own")
    named = materialise(found.join(own, "doc_id"), "named")
    firsts = materialise(named.groupBy(group).agg(F.min(F.struct("own", "doc_id")).alias("first")), "group-firsts")
    return named.join(firsts, group)


def in_ids(found: DataFrame, apart: DataFrame, group: str) -> DataFrame:
    """``found`` (doc_id, group, kept, ...) over the rows ``apart``, in the documents' own ids; a group has its least."""
    put = {"doc_id": F.col("own"), group: F.col("first.own"), "kept": F.col("own") == F.col("first.own")}
    return owned(found, apart, group).select(*[put.get(c, F.col(c)).alias(c) for c in found.columns])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_salt(df: DataFrame, row_key: str, salts: int) -> DataFrame:
    """Add ``salt`` in [0, salts), fixed by ``row_key``."""
    return df.withColumn("salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int) -> DataFrame:
    """One copy of each row for every salt; the other side of ``with_salt``."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _flagged(docs: DataFrame, ids: DataFrame, most_bits: int, key: Column, name: str) -> tuple[DataFrame, Column]:
    """``docs`` and whether a row's ``key`` may be in column ``name`` of ``ids``, by a broadcast bitmap.

    The bitmap has at least 16 hashed bits an id.  Its size is known from the count of
    ``ids``; beyond ``most_bits`` (32 MB) no bitmap is made and every row may be in.
    """
    bits = 1 << max(15, (16 * ids.count() - 1).bit_length())
    if bits > most_bits:
        return docs, F.lit(True)
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    bucket, bitmap = unused(docs, "_bucket"), unused(docs, "_bitmap")
    maps = ids.select(place(F.col(name)).alias("p")).groupBy(F.shiftright("p", 15).alias(bucket)).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias(bitmap))
    found = docs.join(F.broadcast(maps), F.shiftright(place(key), 15) == F.col(bucket), "left")
    at = place(key).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return found, F.coalesce(bit == 1, F.lit(False))


def maybe_in(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 28, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key`` may be in ``ids``; no row whose key is there is lost.

    Spares the texts of other documents the shuffle of the exact join that follows.
    ``ids`` should be a written table, as it is read twice.
    """
    return sifted(docs, ids, key, most_bits)[1]


def sifted(docs: DataFrame, ids: DataFrame, key: str, most_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose ``key`` is surely not in ``ids``, and those whose may be."""
    found, flag = _flagged(docs, ids, most_bits, F.col(key), key)
    columns = [docs[c] for c in docs.columns]
    return found.filter(~flag).select(*columns), found.filter(flag).select(*columns)


def parted(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose ``row_id`` is not in ``ids`` (doc_id), and those whose is; few others are shuffled."""
    found, flag = _flagged(docs, ids, most_bits, row_id(), "doc_id")
    columns, name = [docs[c] for c in docs.columns], unused(docs, "_id")
    sure = found.filter(~flag).select(*columns)
    maybe, wanted = found.filter(flag).select(*columns), ids.select(F.col("doc_id").alias(name)).distinct()
    out = [maybe.join(wanted, row_id() == F.col(name), how).select(*docs.columns) for how in ("left_anti", "left_semi")]
    return sure.unionByName(out[0]), out[1]


def without(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` whose ``row_id`` is not in ``ids``."""
    return parted(docs, ids, most_bits)[0]


def _unhashable(kind: DataType) -> bool:
    return any(name in kind.simpleString() for name in (MapType.typeName(), VariantType.typeName()))


def kept_once(docs: DataFrame, found: DataFrame, text: Column, name: str) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, kept; a row for each) keeps, in all their columns.

    ``doc_id`` stands for one text (else see ``kept_apart``).  Of rows with one ``doc_id`` and
    an equal ``text`` one stays, whichever has the least hash of its columns.
    """
    found = materialise(found.select("doc_id", "kept"), name)
    rows = without(docs, materialise(found.filter("not kept").select("doc_id").distinct(), f"{name}-gone"))
    repeated = materialise(found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), f"{name}-repeated")
    if repeated.isEmpty():
        return rows
    once, again = parted(rows, repeated)
    plain = [F.to_json(F.struct(c)) if _unhashable(docs.schema[c].dataType) else F.col(c) for c in docs.columns]
    one = again.groupBy(row_id().alias("i"), F.sha2(text, 256).alias("t")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("one"))
    return once.unionByName(one.select("one.*"))


def kept_apart(apart: DataFrame, found: DataFrame, group: str, text: Column, name: str) -> DataFrame:
    """``kept_once`` for rows ``told_apart``: of each ``group`` in ``found`` the row with the least ``own`` stays."""
    first = owned(found, apart, group).select("doc_id", (F.col("doc_id") == F.col("first.doc_id")).alias("kept"))
    return kept_once(apart, first, text, name).select("row.*")


#: Bytes of an Arrow batch of rows that go to Python, see ``small_batches``.
BATCH_BYTES = 1 << 19
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of about ``BATCH_BYTES``, a longer row alone.

    By default a batch has 10,000 rows, most of a partition of whole texts: the executor
    holds it as buffers outside its heap, and each Python worker as a batch, as strings and as
    what is made from them.  A limit that the session has set already stays.  The setting holds
    on, as Spark reads it when a plan is run, and changes no result.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(parts: Column, sep: str = ",") -> Column:
    return F.array_join(parts, sep)
