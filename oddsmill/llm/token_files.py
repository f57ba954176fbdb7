"""Token-id files: Parquet list columns in ascending ``doc_id`` order.

Documents are dealt out by ranges of ``doc_id`` and sorted within each range, so
file ``k`` holds smaller ids than file ``k + 1``.  A row is one document: its
file number, ``doc_id``, ``n_tokens`` and the list ``ids``.  The list column is
dictionary encoded (token ids repeat), the metadata columns are delta encoded,
row groups and pages have set sizes, and Parquet's page index is written, so a
reader can fetch the metadata alone, or the ids of a few documents, without
touching the other pages.

Encoding goes by units: a place between a visible character and a single space
that precedes another visible character always starts a new pre-token, so a text
can be cut there and every distinct unit is encoded by the library once.  Texts
with other arrangements of white space are encoded whole.

Edge cases: a null text is empty and holds the end id alone; repeated rows follow
each other; an empty table writes no ids; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import shared_dir, tasks, texts

SCHEMA = "file_no int, doc_id long, n_tokens int, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
FILE_BYTES = 64 << 20
UNITS_KEPT = 500_000  # of each of two generations
JOINED = 2000  # new units that are encoded together
SLICE = 8 << 20


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct unit once while it is remembered."""

    def __init__(self, path: str, kept: int = UNITS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = kept
        # Two generations of units that follow a space; the older one is forgotten when the younger is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True

    def _ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def encode(self, batch: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end id, and where each text ends."""
        lists = pc.split_pattern(batch, " ")
        ends = np.asarray(lists.offsets)[1:]
        starts = np.concatenate([[0], ends[:-1]])
        units = lists.flatten().dictionary_encode()
        known = self._learnt(units.dictionary.to_pylist())
        at = np.asarray(units.indices).astype(np.int64)
        # A first unit does not follow a space; a text whose units are not plain is encoded whole.
        whole = np.array([not k for k in known])[at]
        whole[starts] = False
        first = units.take(pa.array(starts)).to_pylist()
        odd = np.logical_or.reduceat(whole, starts) | np.array([u[-1:].isspace() for u in first])
        first = self._ids([t.as_py() if o else u for t, o, u in zip(batch, odd, first, strict=True)])
        parts = [*known, b"", np.array([end_id], "<u4").tobytes(), *[i.tobytes() for i in first]]
        at[np.repeat(odd, ends - starts)] = len(known)
        at[starts] = len(known) + 2 + np.arange(len(batch))
        taken = pa.array(parts, pa.binary()).take(pa.array(np.insert(at, ends, len(known) + 1)))
        _, offsets, data = taken.buffers()
        done = np.frombuffer(offsets, np.int32) // 4
        return np.frombuffer(data, "<i4"), done[1 + ends + np.arange(len(batch))]

    def _learnt(self, units: list[str]) -> list[bytes]:
        """Ids of units that follow a space; none for one whose text must be encoded whole."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        known = list(map(self.young.get, units))
        fresh = []
        for k, ids in enumerate(known):
            if ids is None:
                u = units[k]
                ids = self.old.get(u)
                if ids is None and u and not u[0].isspace() and not u[-1].isspace():
                    fresh.append(k)
                else:
                    known[k] = self.young[u] = ids or b""
        for at in range(0, len(fresh), JOINED):
            places = fresh[at : at + JOINED]
            # Every space begins a pre-token, so a unit's ids begin at a token that begins with one.
            ids = self._ids(["".join(" " + units[k] for k in places)])[0]
            cuts = np.flatnonzero(self.spaced[ids]) * 4
            if len(cuts) != len(places):
                raise ValueError("a token holds a space that does not begin it")
            data, cuts = ids.tobytes(), [*cuts.tolist(), 4 * len(ids)]
            for k, a, b in zip(places, cuts, cuts[1:], strict=False):
                known[k] = self.young[units[k]] = data[a:b]
        return known


@lru_cache(2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE`` bytes of a text column."""
    at, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n
        if size > SLICE:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def token_rows(docs: DataFrame, path: str, end_id: int, files: int) -> DataFrame:
    """Rows of ``SCHEMA``, dealt out and sorted by ``doc_id``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path)
        for batch in batches:
            for part in slices(batch, 2):
                values, ends = encoder.encode(part.column(2), end_id)
                ends = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(ends)), lists], ["file_no", "doc_id", "n_tokens", "ids"])

    dealt = texts(docs).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return dealt.select(F.spark_partition_id().alias("file_no"), "doc_id", "text").mapInArrow(encoded, SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, files: int, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    (
        token_rows(docs, path, end_id, files)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
        .parquet(out)
    )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Columns that are not selected are not read; filters on ``doc_id`` skip pages by the page index."""
    return spark.read.schema(SCHEMA).parquet(out)


def starts(meta: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``start``: the ids in all rows before. One running sum a file, after the sums of earlier files.

    ``sizes``: file_no and n_tokens of the same rows.
    """
    totals = sizes.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    offsets = totals.select("file_no", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
    own = F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1))
    return meta.withColumn("own", F.coalesce(own, F.lit(0))).join(offsets, "file_no").withColumn("start", F.col("offset") + F.col("own")).drop("own", "offset")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``file_no, doc_id, n_tokens, ids_crc32`` of rows of ``SCHEMA``: the digest of the ids as little-endian 32-bit integers."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, data = np.asarray(ids.offsets).tolist(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["file_no", "doc_id", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digests, "file_no int, doc_id long, n_tokens int, ids_crc32 long")


def file_count(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files of about ``file_bytes`` of text, so that a file does not grow with the data; a task for each core at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(tasks(docs.sparkSession), -(-size // file_bytes))


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the files into the shared folder, read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, path, end_id, file_count(docs))
    rows = read_tokens(spark, out)
    return starts(with_crc32(rows), rows.select("file_no", "n_tokens")).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
