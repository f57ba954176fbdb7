"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space), cut
into byte chunks, and every chunk gets a polynomial hash under two prime moduli
below 2**31.  Chunk hashes compose by length-shifted arithmetic,
``H(a + b) = H(a) * B**len(b) + H(b)``, so the chunks of a huge document are
hashed in parallel tasks.  Documents with equal length and fingerprint are then
compared with the first of their group chunk by chunk; those that differ form
groups of their own in the next round, so a collision costs time, never a
document.

Edge cases: a null text counts as empty, and empty texts are equal to each
other; a row that occurs twice (same ``doc_id`` and text) yields two equal output
rows and counts twice in ``group_size``, and ``drop_duplicates`` keeps one of them; a
null ``doc_id`` is named by a hash of the text; rows of one ``doc_id`` with different texts
are documents of their own, each in the group of its text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import clashing, in_ids, kept_apart, kept_once, materialise, maybe_in, texts, told_apart

CHUNK = 1 << 16
HUGE = 1 << 20
MODULI = (2147483647, 2147483629)
BASE = 1_000_003
PER_SALT = 500


@lru_cache(8)
def _powers(modulus: int, length: int) -> np.ndarray:
    """``BASE**(length-1) ... BASE**0`` under ``modulus``."""
    out = np.empty(length, np.uint64)
    value = 1
    for i in range(length - 1, -1, -1):
        out[i] = value
        value = value * BASE % modulus
    return out


def chunk_hash(data: bytes, modulus: int, length: int = CHUNK) -> int:
    """Polynomial hash of at most ``length`` bytes; a byte counts as 1 to 256."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    powers = _powers(modulus, length)[length - len(values) :]
    return int((values * powers).sum() % np.uint64(modulus))


def _hash_udf(moduli: tuple[int, int], length: int):
    @F.pandas_udf("h1 long, s1 long, h2 long, s2 long")
    def hashed(chunks: pd.Series) -> pd.DataFrame:
        shift: dict[int, tuple[int, int]] = {}
        rows = []
        for data in chunks:
            n = len(data)
            if n not in shift:
                shift[n] = tuple(pow(BASE, n, m) for m in moduli)
            s1, s2 = shift[n]
            rows.append((chunk_hash(data, moduli[0], length), s1, chunk_hash(data, moduli[1], length), s2))
        return pd.DataFrame(rows, columns=["h1", "s1", "h2", "s2"])

    return hashed


def normalised(text: str = "text"):
    """White space runs as one space. A lone space is left alone: the same result with far fewer matches."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """One row for each chunk of ``data`` (binary), at least one a document."""
    last = f"greatest(cast(ceil(octet_length(data) / {chunk}) as int), 1) - 1"
    keep = [c for c in docs.columns if c != "data"]
    return docs.select(*keep, F.expr(f"posexplode(transform(sequence(0, {last}), i -> substring(data, i * {chunk} + 1, {chunk})))").alias("chunk_no", "chunk"))


def fingerprints(docs: DataFrame, moduli: tuple[int, int] = MODULI, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """``doc_id, text_sha256, n_bytes, f1, f2, copies`` for each distinct row."""
    rows = docs.select("doc_id", normalised().alias("norm")).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("data"))
    size = F.octet_length("data")
    # The chunks of a huge document are dealt out to all tasks; others are hashed where they are read.
    parts = _chunks(rows.filter(size <= huge), chunk).unionByName(_chunks(rows.filter(size > huge), chunk).repartition("doc_id", "chunk_no"))
    hashed = parts.select("doc_id", "text_sha256", "chunk_no", F.octet_length("chunk").alias("n"), _hash_udf(moduli, chunk)("chunk").alias("h"))
    grouped = hashed.groupBy("doc_id", "text_sha256").agg(F.collect_set(F.struct("chunk_no", "n", "h")).alias("parts"), F.count_if(F.col("chunk_no") == 0).alias("copies"))

    def composed(h: str, s: str, modulus: int):
        return F.aggregate(F.array_sort("parts"), F.lit(0).cast("long"), lambda acc, x: (acc * x["h"][s] + x["h"][h]) % F.lit(modulus))

    return grouped.select(
        "doc_id", "text_sha256", F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_bytes"),
        composed("h1", "s1", moduli[0]).alias("f1"), composed("h2", "s2", moduli[1]).alias("f2"), "copies",
    )


def _unequal(docs: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """``doc_id`` of the pairs (doc_id, keep_id) whose normalised texts differ in any chunk."""
    first = pairs.select(F.col("keep_id").alias("doc_id"), "keep_id", "salts").distinct()
    wanted = materialise(pairs.select("doc_id", "keep_id", "salts").unionByName(first), "compared")
    # One plan at every size: a broadcast of the ids would not hold beyond small tables.
    data = maybe_in(docs, wanted).join(wanted.hint("merge"), "doc_id").select("doc_id", "keep_id", "salts", normalised().cast("binary").alias("data"))
    rows = _chunks(data, chunk)
    # The first text of a large group is copied once for every PER_SALT members.
    members = rows.filter("doc_id <> keep_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    firsts = rows.filter("doc_id = keep_id").select("keep_id", "chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("chunk").alias("first_chunk"))
    both = members.join(firsts, ["keep_id", "chunk_no", "salt"], "left")
    return both.filter(~F.col("chunk").eqNullSafe(F.col("first_chunk"))).select("doc_id").distinct()


def _grouped(docs: DataFrame, prints: DataFrame, chunk: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` where a ``doc_id`` stands for one text."""
    key = ["n_bytes", "f1", "f2"]
    left = prints.select("doc_id", "copies", *key)
    found = None
    while True:
        groups = left.groupBy(key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("members")).filter("members > 1")
        # Both sides are read from written tables, so that Spark can split the partition of a large group.
        groups = materialise(groups.select(*key, "keep_id", (1 + F.floor(F.col("members") / PER_SALT)).alias("salts")), "groups")
        pairs = materialise(left.join(groups, key).select("doc_id", "keep_id", "copies", "salts", *key), "pairs")
        differ = materialise(_unequal(docs, pairs.filter("doc_id <> keep_id"), chunk), "unequal")
        same = pairs.join(differ, "doc_id", "left_anti").select("doc_id", "keep_id", "copies")
        found = same if found is None else found.unionByName(same)
        if differ.isEmpty():
            break
        left = pairs.join(differ, "doc_id", "left_semi").select("doc_id", "copies", *key)
    sizes = materialise(found.groupBy("keep_id").agg(F.sum("copies").alias("group_size")), "sizes")
    known = found.join(sizes, "keep_id").select("doc_id", "keep_id", "group_size")
    out = prints.join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", "copies").alias("group_size"), "text_sha256", "copies",
    )
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.withColumn("nth", one).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def _found(docs: DataFrame, moduli: tuple[int, int] = MODULI, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """The groups of ``docs``, and its rows ``told_apart`` where a ``doc_id`` stands for different texts."""
    rows, apart = texts(docs), None
    prints = materialise(fingerprints(rows, moduli, chunk), "fingerprints")
    twice = clashing(prints, "text_sha256")
    if not twice.isEmpty():
        rows = apart = told_apart(docs, twice)
        prints = materialise(fingerprints(rows, moduli, chunk), "fingerprints")
    return _grouped(rows, prints, chunk), apart


def exact_duplicates(docs: DataFrame, moduli: tuple[int, int] = MODULI, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (doc_id, text)."""
    found, apart = _found(docs, moduli, chunk)
    return found if apart is None else in_ids(found, apart, "keep_id")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in all their columns, that stay: one of each group of equal texts."""
    found, apart = _found(docs)
    return kept_once(docs, found, normalised(), "exact-copies") if apart is None else kept_apart(apart, found, "keep_id", normalised(), "exact-copies")
