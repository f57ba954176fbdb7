"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into paragraphs (sentences and lines, long ones at 160 characters)
and each distinct paragraph is hashed to 64 bits.  A sketch has three tables of
cells; a digest falls into one cell of each, where digests and their check values
are XORed and counted.  The cells of two versions subtract; peeling then recovers
the differing digests, by side, from cells that hold just one.

If peeling stops early, the sketches are built again, larger.  The digests of both
versions are dealt into shards of about ``SHARD`` by their value, in one sort, so that the
work grows with the length of the text; the counts of the base cells tell how many
digests of a shard may differ and so the first width.  A shard that fails again is
tried with twice the cells, until all its digests are recovered.

The likeness of two versions is ``(|A| + |B| - d) / (|A| + |B| + d)`` for d recovered
digests: the Jaccard similarity of their paragraph sets.

Everything is built-in functions: no Python runs on the executors.

Edge cases: a null text is empty; two empty texts have likeness 1; a repeated
paragraph counts once; with one document the next document is itself; repeated rows
(same ``doc_id``) yield equal rows; a null ``doc_id`` is named by a hash of the text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise, tasks, texts

TABLES = 3
CELLS = 8  # of each table of the base sketch
SHARD = 32
ROUNDS = 14
TRIES = 24  # with twice the cells each; a shard that needs more is an error
PARAGRAPH = r"(?s)[^\n]{24,160}?[.!?\n]+|[^\n]{1,160}\n*|\n+"


def digests(text: Column) -> Column:
    """Distinct 64-bit hashes of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _places(check: Column, cells: Column) -> list[Column]:
    """The cell of a digest within each table: other bits of its check value for every table."""
    out = []
    for table in range(TABLES):
        bits = F.call_function("shiftrightunsigned", check, F.lit(20 * table))
        out.append(F.pmod(bits.bitwiseAND(F.lit(1048575)).cast("int"), cells).alias(f"p{table}"))
    return out


def sketch(found: Column, cells: Column) -> Column:
    """``TABLES * cells`` structs (count, key, check) of an array of digests."""
    checked = F.transform(found, lambda d: F.struct(d.alias("d"), _check(d).alias("c")))
    keyed = F.transform(checked, lambda x: F.struct(x["d"].alias("d"), x["c"].alias("c"), *_places(x["c"], cells)))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"), acc["k"].bitwiseXOR(x["d"]).alias("k"), acc["c"].bitwiseXOR(x["c"]).alias("c"))

    def table(t: int, own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (cells - 1).cast("int")), lambda j: F.aggregate(F.filter(own, lambda x: x[f"p{t}"] == j), empty, add))

    # The keyed digests are bound once for all tables.
    return F.transform(F.array(keyed), lambda own: F.concat(*[table(t, own) for t in range(TABLES)]))[0]


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, width: Column, rounds: int = ROUNDS) -> Column:
    """The digests that a subtracted sketch gives up, by side: ``a``, ``b``, and whether that is ``all``."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("a"), none.alias("b"), F.lit(True).alias("more"))

    def take(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] - p["n"]).alias("n"), acc["k"].bitwiseXOR(p["k"]).alias("k"), acc["c"].bitwiseXOR(p["c"]).alias("c"))

    def table(state: Column, t: int, own: Column) -> Column:
        part = F.slice(state["cells"], (width * t + 1).cast("int"), width.cast("int"))
        return F.transform(part, lambda c, j: F.aggregate(F.filter(own, lambda p: p[f"p{t}"] == j), c, take))

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        keys = F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["c"].alias("c"), *_places(c["c"], width))))

        def without(own: Column) -> Column:
            cells = F.when(F.size(own) > 0, F.concat(*[table(state, t, own) for t in range(TABLES)])).otherwise(state["cells"])
            sides = (F.concat(state[c], F.transform(F.filter(own, lambda p: p["n"] == n), lambda p: p["k"])).alias(c) for c, n in (("a", 1), ("b", -1)))
            return F.struct(cells.alias("cells"), *sides, (F.size(own) > 0).alias("more"))

        # The keys are bound once for all cells.
        return F.when(state["more"], F.transform(F.array(keys), without)[0]).otherwise(state)

    def verdict(state: Column) -> Column:
        left = F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))
        return F.struct(state["a"].alias("a"), state["b"].alias("b"), (~left).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, verdict)


def estimate(cells: Column, a: Column, b: Column) -> Column:
    """Differing digests from the counts of a subtracted sketch that peeling can't open."""
    m = F.size(cells)
    squares = F.aggregate(cells, F.lit(0).cast("long"), lambda acc, c: acc + c["n"].cast("long") * c["n"])
    even = (a - b).cast("double") * (a - b) * (TABLES * TABLES) / m
    return F.least(F.greatest((squares - even) / (TABLES * (1 - F.lit(float(TABLES)) / m)), F.abs(a - b)), a + b)


def _dealt(found: Column, shards: Column) -> Column:
    """``shards`` arrays of the digests by ranges of their value: one sort, with the least value of each range put in."""
    step = F.call_function("div", F.lit(2**63 - 1), shards.cast("long")) + 1
    first = F.transform(F.sequence(F.lit(0), shards - 1), lambda k: (k.cast("long") * step - 2**62) * 2)
    shard = lambda d: F.call_function("div", F.shiftright(d, 1) + 2**62, step)

    def cut(ordered: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (shard(F.element_at(ordered, i)) != shard(F.element_at(ordered, F.greatest(i - 1, F.lit(1))))))

        def slices(starts: Column) -> Column:
            return F.transform(starts, lambda i, k: F.slice(ordered, i + 1, F.coalesce(F.get(starts, k + 1), F.size(ordered) + 1) - i - 1))

        return F.transform(F.array(at), slices)[0]

    return F.transform(F.array(F.sort_array(F.concat(found, first))), cut)[0]


def differing(a: Column, b: Column, guess: Column) -> Column:
    """The digests of only one of two arrays, by side (``a``, ``b``), by larger sketches in shards; about ``guess`` may differ."""
    shards = F.greatest(F.ceil(F.greatest(F.size(a), F.size(b)) / SHARD), F.lit(2)).cast("int")
    each = F.greatest(guess, F.lit(1)) / shards
    none = F.array().cast("array<bigint>")

    def recovered(s: Column) -> Column:
        start = F.struct(none.alias("a"), none.alias("b"), F.lit(False).alias("all"))
        # Three tables open at 1.23 cells a digest; the root leaves room for shards that got more than others.
        width = F.ceil((1.4 * (each + 2 * F.sqrt(each))) / TABLES).cast("int") + 3

        def attempt(state: Column, k: Column) -> Column:
            w = (width * F.call_function("shiftleft", F.lit(1), k) + k).cast("int")
            again = F.transform(F.array(w), lambda w: peel(subtract(sketch(s["x"], w), sketch(s["y"], w)), w))[0]
            return F.when(state["all"], state).otherwise(again)

        done = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, attempt)
        return F.transform(F.array(done), lambda d: F.when(d["all"], d).otherwise(F.raise_error(F.lit("two digests share their cells at every width")).cast("struct<a:array<bigint>,b:array<bigint>,all:boolean>")))[0]

    parts = F.transform(F.zip_with(_dealt(a, shards), _dealt(b, shards), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), recovered)
    return F.transform(F.array(parts), lambda p: F.struct(*[F.flatten(F.transform(p, lambda d: d[c])).alias(c) for c in "ab"]))[0]


def likeness(d: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.greatest((a + b - d) / (a + b + d).cast("double"), F.lit(0.0)))


def printed(cells: Column, n: Column) -> Column:
    """A sketch as text: the number of digests and the cells in hexadecimal."""
    return F.concat(n.cast("string"), F.lit(":"), F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"].cast("long")), F.hex(c["k"]), F.hex(c["c"]))), ","))


def compared(pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Add ``sketch_a``, ``sketch_b``, ``likeness`` and ``likeness_digests`` (a, b: digests of one side only) to rows with digest arrays ``a`` and ``b``."""
    width = F.lit(cells)
    rows = pairs.withColumn("sketch_a", sketch(F.col("a"), width)).withColumn("sketch_b", sketch(F.col("b"), width))
    return _compared(rows, "a", "b", "sketch_a", "sketch_b", "likeness", cells)


def _compared(rows: DataFrame, a: str, b: str, sa: str, sb: str, out: str, cells: int) -> DataFrame:
    """Add ``out``, the likeness, and ``{out}_digests``, the recovered digests by side."""
    na, nb = F.size(a), F.size(b)
    rows = rows.withColumn("_cells", subtract(F.col(sa), F.col(sb)))
    rows = rows.withColumn("_peeled", peel(F.col("_cells"), F.lit(cells)))
    sides = F.struct(F.col("_peeled.a").alias("a"), F.col("_peeled.b").alias("b"))
    found = F.when(F.col("_peeled.all"), sides).otherwise(differing(F.col(a), F.col(b), estimate(F.col("_cells"), na, nb)))
    rows = rows.withColumn(f"{out}_digests", found)
    d = F.size(f"{out}_digests.a") + F.size(f"{out}_digests.b")
    return rows.withColumn(out, likeness(d, na, nb)).drop("_cells", "_peeled")


def successors(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id``: the next larger id, after the last the first; no task holds all ids."""
    ids = docs.select("doc_id").distinct()
    dealt = materialise(ids.repartitionByRange(tasks(docs.sparkSession), "doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ids")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))  # one row a partition
    after = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())).alias("after"))
    within = dealt.withColumn("lead", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return within.join(F.broadcast(after), "part").select("doc_id", F.coalesce("lead", "after").alias("next_id"))


def versions(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Every text against its edited form and against the next document.

    The edited form replaces the last quarter of the characters by as many of the
    next document's first ones.  Columns: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    docs = texts(docs)
    follow = materialise(successors(docs), "successors")
    quarter = F.floor(F.length("text") / 4).cast("int")
    wanted = docs.select("doc_id", quarter.alias("quarter")).join(follow, "doc_id").distinct()
    # Both joins take the texts by id under the same names, so that they are shuffled once.
    by_id = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("whole"))
    met = by_id.join(wanted.withColumnRenamed("next_id", "id").hint("merge"), "id")
    brought = met.select("doc_id", F.expr("substring(whole, 1, quarter)").alias("lead"), digests(F.col("whole")).alias("digests_n"))
    brought = brought.groupBy(F.col("doc_id").alias("id")).agg(F.first("lead").alias("lead"), F.first("digests_n").alias("digests_n"))
    both = by_id.join(brought.hint("merge"), "id").withColumnsRenamed({"id": "doc_id", "whole": "text"})
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.col("lead"))
    rows = both.select("doc_id", "text", edited.alias("edited"), "digests_n")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("digests_a"), digests(F.col("edited")).alias("digests_e"), "digests_n")
    width = F.lit(cells)
    for kind in "aen":
        rows = rows.withColumn(f"sketch_{kind}", sketch(F.col(f"digests_{kind}"), width))
    rows = _compared(rows, "digests_a", "digests_e", "sketch_a", "sketch_e", "near_edited", cells)
    rows = _compared(rows, "digests_a", "digests_n", "sketch_a", "sketch_n", "near_next", cells)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("sketch_a"), F.size("digests_a")).alias("fingerprint"),
        printed(F.col("sketch_e"), F.size("digests_e")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
