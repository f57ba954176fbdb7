"""Near-duplicate detection by MinHash, banding, verification and components.

1. Each text becomes its set of hashed 5-word shingles, 200 universal hash minima
   over it, one key for each band of 5 minima, and a digest of the whole set.
2. Texts with the same set are one class; only classes are compared.
3. Rounds of stars: in every band bucket whose members are not yet in one component,
   each member is paired with the bucket's first member in an order that changes
   from round to round, if their components differ.  A pair passes the size bound,
   then the signature, and is confirmed on the full sets.  Confirmed links join
   components.  Rounds end when one confirms few links.
4. The rest: buckets whose members are still in different components.  Members of
   small buckets (at most ``SMALL``) are paired across components and confirmed as
   before.  Larger buckets that share members form a crowd; a crowd is cut into
   blocks of about ``BLOCK`` shingles by set size, blocks whose sizes fit meet in
   tasks of their own, and only confirmed links leave a task.

A pair of similarity 0.75 shares no band with probability 2e-5, and the signature
bound (0.6 of the minima) rejects it with a smaller one.  There is no cap on
partners or candidates.

Edge cases: texts without words (null, empty, white space) have no shingle and are
their own component; repeated rows share one class and one ``doc_id``, and
``drop_near_duplicates`` keeps one of them; a null ``doc_id`` is named by a hash of the
text; rows of one ``doc_id`` whose texts differ in their shingles are documents of their own;
texts of fewer than five words have one shingle; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from oddsmill.llm.common import clashing, in_ids, kept_apart, kept_once, materialise, maybe_in, replaced, tasks, texts, told_apart
from oddsmill.llm.components import components
from oddsmill.llm.shingles import MinHash, mix, shingle_sets

BANDS, ROWS = 40, 5
SIZE = 5
SIMILAR = 75  # per cent
AGREE = 0.6
SMALL = 64
TURNS = 8
BLOCK = 50_000
SLICE = 128


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """``doc_id, n, d1, d2, keys, short``: set size, set digest, band keys and one byte of every minimum."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, d1, d2, keys, short = [], [], [], [], []
                for found in shingle_sets([t.encode() for t in part.column(1).to_pylist()], size):
                    n.append(len(found))
                    d1.append(found.sum(dtype=np.uint64) if len(found) else np.uint64(0))
                    d2.append(np.bitwise_xor.reduce(mix(found)) if len(found) else np.uint64(0))
                    minima = hashes.minima(found) if len(found) else None
                    keys.append(hashes.band_keys(minima) if len(found) else np.zeros(0, np.uint64))
                    short.append(hashes.short(minima) if len(found) else b"")
                ends = np.cumsum([0] + [len(k) for k in keys], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), lists, pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "keys", "short"])

    return texts(docs).mapInArrow(signed, "doc_id long, n long, d1 long, d2 long, keys array<long>, short binary")


def _agreement(a: str, b: str):
    """Share of equal minima, from one byte of each."""

    @F.pandas_udf(DoubleType())
    def share(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) for x, y in zip(left, right, strict=True)], dtype="float64")

    return share(a, b)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, shingles``: the full sets, sorted."""

    @F.pandas_udf(ArrayType(LongType()))
    def full(part: pd.Series) -> pd.Series:
        # A slice at a time: hashing takes tens of bytes for each byte of the texts at hand.
        slices = (part.iloc[at : at + SLICE] for at in range(0, len(part), SLICE))
        return pd.Series([s.view(np.int64) for own in slices for s in shingle_sets([t.encode() for t in own], size)], dtype=object)

    return docs.select("doc_id", full("text").alias("shingles"))


def _confirmed(pairs: DataFrame, signs: DataFrame, docs: DataFrame, similar: int, size: int) -> DataFrame:
    """The pairs (a, b, na, nb, ca, cb) that are links: by set sizes, then signature, then the full sets."""
    fit = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar)
    short = signs.select("doc_id", "short")
    fit = fit.join(short.withColumnsRenamed({"doc_id": "a", "short": "sa"}), "a").join(short.withColumnsRenamed({"doc_id": "b", "short": "sb"}), "b")
    likely = materialise(fit.filter(_agreement("sa", "sb") >= AGREE).select(*pairs.columns), "likely")
    ids = materialise(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "likely-ids")
    sets = materialise(_sets(maybe_in(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), size), "likely-sets")
    both = likely.join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "xb"}), "b").join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "xa"}), "a")
    shared = F.size(F.array_intersect("xa", "xb")).cast("long")
    return both.withColumn("shared", shared).filter(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * similar).select("a", "b", "ca", "cb")


def _block_links(similar: int):
    """Links between two blocks (side 0 and 1) of a crowd, or within one, on the full sets."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["side"] == 0]
        right = rows[rows["side"] == 1] if (rows["side"] == 1).any() else left
        sets = [np.asarray(x, np.int64) for x in right["shingles"]]
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids, parts = right["doc_id"].to_numpy(), right["c"].to_numpy()
        mark, out = np.zeros(len(names), bool), []
        for a, ca, x in zip(left["doc_id"], left["c"], left["shingles"], strict=True):
            x = np.asarray(x, np.int64)
            place = np.minimum(np.searchsorted(names, x), len(names) - 1)
            own = place[names[place] == x]
            mark[own] = True
            shared = np.add.reduceat(mark[at].astype(np.int64), starts)
            mark[own] = False
            link = (shared * 100 >= (sizes + len(x) - shared) * similar) & (parts != ca)
            out += [(a, b, ca, cb) for b, cb in zip(ids[link].tolist(), parts[link].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "ca", "cb"])

    return found


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Add ``block`` to ``members`` (crowd, n, doc_id, ...): about ``block`` shingles each, by set size.

    Running sums by ranges of the order, after the sums of the ranges before: no task
    holds a crowd.
    """
    order = ["crowd", "n", "doc_id"]
    dealt = materialise(members.repartitionByRange(tasks(members.sparkSession), *order).withColumn("part", F.spark_partition_id()), "crowd-ranges")
    sums = dealt.groupBy("crowd", "part").agg(F.sum("n").alias("own"))  # a row for each range that a crowd meets
    before = Window.partitionBy("crowd").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("crowd", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("crowd", "part").orderBy("n", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(sums, ["crowd", "part"]).withColumn("block", F.floor(upto / block)).drop("part", "before")


def _crowd_links(docs: DataFrame, rows: DataFrame, similar: int, size: int, block: int) -> DataFrame:
    """Links (a, b, ca, cb) across components among the members of large open buckets: ``rows`` (key, doc_id, n, c)."""
    firsts = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("first")), "crowd-firsts")
    crowds = components(rows.join(firsts, "key").select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    members = rows.select("doc_id", "n", "c").distinct().join(crowds.select(F.col("node").alias("doc_id"), F.col("component").alias("crowd")), "doc_id")
    members = materialise(_in_blocks(members, block), "crowds")
    spans = members.groupBy("crowd", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    later = spans.select("crowd", F.col("block").alias("j"), F.col("lo").alias("lo_j"))
    pairs = spans.join(later, "crowd").filter((F.col("block") <= F.col("j")) & (F.col("hi") * 100 >= F.col("lo_j") * similar))
    pairs = materialise(pairs.select("crowd", F.col("block").alias("i"), "j"), "block-pairs")
    sides = pairs.select("crowd", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(pairs.filter("i < j").select("crowd", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    sets = materialise(_sets(maybe_in(docs, members).join(members.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), size), "crowd-sets")
    rows = members.join(sets, "doc_id").join(sides, ["crowd", "block"])
    return rows.groupBy("crowd", "i", "j").applyInPandas(_block_links(similar), "a long, b long, ca long, cb long")


def _moved(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """``known`` (node, component) of linked nodes, after further links (ca, cb) between components."""
    moved = components(links.select(F.col("ca").alias("u"), F.col("cb").alias("v")))
    if known is None:
        return materialise(moved, "components")
    to = materialise(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "moved")
    old = known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = to.select(F.col("component").alias("node"), F.col("to").alias("component")).join(known, "node", "left_anti")
    return replaced(old.unionByName(new), "components", known)


def _placed(still: DataFrame, known: DataFrame) -> DataFrame:
    """``still`` (key, doc_id, n, members, c) in the components that are ``known`` now."""
    joined = still.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return materialise(joined.select("key", "doc_id", "n", "members", F.coalesce("component", "doc_id").alias("c")), "placed")


def _open(placed: DataFrame) -> DataFrame:
    """The rows in buckets that hold more than one component."""
    keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    return materialise(placed.join(materialise(keys, "open-keys"), "key", "left_semi"), "open")


def _stars(still: DataFrame, turn: int) -> DataFrame:
    """Each member with the first of its bucket in the order of this round, if their components differ."""
    order = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
    first = materialise(still.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))).alias("f")).select("key", "f.a", "f.na", "f.ca"), "firsts")
    pairs = still.join(first, "key").filter("c <> ca").select("a", F.col("doc_id").alias("b"), "na", F.col("n").alias("nb"), "ca", F.col("c").alias("cb"))
    return pairs.dropDuplicates(["a", "b"])


def _across(still: DataFrame) -> DataFrame:
    """Pairs across components that may be links, of small buckets."""
    left = still.select("key", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    right = still.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    return pairs.drop("key").dropDuplicates(["a", "b"])


def linked(docs: DataFrame, signs: DataFrame, classes: DataFrame, similar: int = SIMILAR, size: int = SIZE, small: int = SMALL, turns: int = TURNS, block: int = BLOCK) -> DataFrame:
    """``node, component`` of the class representatives that are linked with others.

    ``classes``: doc_id, rep.  Components are those of all links between classes.
    """
    reps = signs.join(classes.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = materialise(reps.select("doc_id", "n", F.explode("keys").alias("key")), "bands")
    buckets = materialise(rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    placed = materialise(rows.join(buckets, "key").select("key", "doc_id", "n", "members", F.col("doc_id").alias("c")), "shared")
    none = placed.select(F.col("doc_id").alias("node"), F.col("c").alias("component")).limit(0)
    if placed.isEmpty():
        return none
    docs = docs.select("doc_id", "text")
    still, tried, known = placed, None, None
    for turn in range(turns):
        pairs = materialise(_stars(still, turn), "stars")
        found = materialise(_confirmed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), signs, docs, similar, size), "links")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links, asked = found.count(), still.select("doc_id").distinct().count()
        if links:
            # Buckets that have become one component stay so: only the open ones are carried on.
            known = _moved(known, found)
            still = _open(_placed(still, known))
        if links * 50 < asked:
            break
    few = still.filter(F.col("members") <= small)
    pairs = materialise(_across(few).join(tried, ["a", "b"], "left_anti"), "open-pairs")
    found = _confirmed(pairs, signs, docs, similar, size)
    many = materialise(still.filter(F.col("members") > small).select("key", "doc_id", "n", "c"), "crowded")
    if not many.isEmpty():
        found = found.unionByName(_crowd_links(docs, many, similar, size, block))
    found = materialise(found, "links")
    if not found.isEmpty():
        known = _moved(known, found)
    return none if known is None else known


def _grouped(docs: DataFrame, signs: DataFrame, similar: int, size: int, small: int, block: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` where a ``doc_id`` stands for one set."""
    groups = signs.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    slim = signs.select("doc_id", "n", "d1", "d2")
    classes = materialise(slim.join(materialise(groups, "classes"), ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    known = linked(docs, signs.filter("n > 0"), classes.filter("n > 0"), similar, size, small, block=block)
    placed = classes.join(known, classes["rep"] == known["node"], "left")
    component = F.coalesce("component", "rep")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _found(docs: DataFrame, similar: int = SIMILAR, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """The components of ``docs``, and its rows ``told_apart`` where a ``doc_id`` stands for different sets."""
    own, apart = texts(docs), None
    signs = materialise(signatures(own, bands, rows, size), "signatures")
    twice = clashing(signs, "n", "d1", "d2")
    if not twice.isEmpty():
        own = apart = told_apart(docs, twice)
        signs = materialise(signatures(own, bands, rows, size), "signatures")
    return _grouped(own, signs, similar, size, small, block), apart


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    found, apart = _found(docs, similar, size, bands, rows, small, block)
    return found if apart is None else in_ids(found, apart, "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in all their columns, that stay: one of each component of near duplicates."""
    # Rows of one doc_id that are not told apart share one set; only texts without words differ then.
    (found, apart), text = _found(docs), F.coalesce("text", F.lit(""))
    text = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit("word"))
    return kept_once(docs, found, text, "near-copies") if apart is None else kept_apart(apart, found, "component_id", text, "near-copies")
