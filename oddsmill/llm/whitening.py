"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries become whole numbers, so that counts, sums and squared deviations are exact.
Sums and the centred covariance of the distinct vectors are added up within each task and
then by matrix entry; only matrices of dimension squared reach the driver.  There the
covariance is split: the polar factor of the covariance less a shift, by the dynamically
weighted Halley iteration on QR factorisations, has the eigenvalues +1 and -1, which
makes it a projector onto the components above the shift.  Both invariant subspaces are
split again until they hold one component each; subspaces beyond the components asked
for are left alone.  Mean and components are broadcast (their size depends on the
dimension alone) and every row is projected where it lies.

Edge cases: a row whose vector is null or holds a null or non-finite entry goes; so does
one whose length is not the most frequent one (the longer of equally frequent ones).
Repeated vectors count once in the fit and each keep a row in the result; a null key is
kept.  Components without variance (below ``LEAST`` of the greatest) are left out, so
equal vectors or a single one have none.  Entries beyond the range of a long saturate; a
deviation that no long holds is null.  Columns other than key and vector are ignored; an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LEAST = 1e-12
LONG = (1 << 63) - 1


def halley_polar(a: np.ndarray, most: int = 30) -> np.ndarray:
    """The unitary factor of a symmetric matrix by the QR-based dynamically weighted Halley iteration."""
    n, eps = len(a), np.finfo(float).eps
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the greatest singular value
    low = eps  # a bound below the least one; smaller values only take more steps
    for _ in range(most):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        f = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0)) / 2
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        q = np.linalg.qr(np.vstack([np.sqrt(h) * x, np.eye(n)]))[0]
        new = g / h * x + (f - g / h) / np.sqrt(h) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (f + g * square) / (1 + h * square), 1.0)
        if moved < 10 * eps * np.sqrt(n) and 1 - low < 10 * eps:
            break
    return x


def _projector(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Projector onto the eigenvectors above a shift that splits ``a``, and their number; none if all eigenvalues are equal."""
    n = len(a)
    centre = np.trace(a) / n
    rest = a - centre * np.eye(n)
    spread = np.linalg.norm(rest) / np.sqrt(n)
    if spread <= 4 * np.finfo(float).eps * np.linalg.norm(a):
        return None
    # Eigenvalues lie on both sides of their mean. An eigenvalue at the shift itself has no sign; then the next shift is taken.
    for k in range(2 * n + 2):
        step = (k + 1) // 2 * (1 if k % 2 else -1) / (4 * n + 4)
        c = (halley_polar(rest - step * spread * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(c)))
        if 0 < rank < n and np.linalg.norm(c @ c - c) < 1e-10 * n:
            return c, rank
    return None


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues in falling order, and their unit vectors as columns (the greatest entry positive)."""
    draw = np.random.default_rng(0)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    stack = [(np.eye(len(covariance)), (covariance + covariance.T) / 2)]
    while stack and len(values) < most:
        basis, a = stack.pop()
        split = _projector(a) if len(a) > 1 else None
        if split is None:
            for k in range(len(a)):
                values.append(a[k, k])
                vectors.append(basis[:, k])
            continue
        c, rank = split
        q = np.linalg.qr(c @ draw.standard_normal((len(a), rank)))[0]
        q = np.linalg.qr(c @ q, mode="complete")[0]
        for part in (q[:, rank:], q[:, :rank]):
            own = basis @ part
            own = np.linalg.qr(own)[0]  # rounding of the products does not add up from split to split
            stack.append((own, own.T @ covariance @ own))
    w = np.column_stack(vectors)[:, :most] if vectors else np.zeros((len(covariance), 0))
    e = np.array(values[:most])
    return e, w * np.where(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)


def whole_entries(vector: Column) -> Column:
    """``floor(SCALE * entry) + OFFSET`` as longs."""
    return F.transform(vector, lambda c: F.least(F.floor(SCALE * c.cast("double")), F.lit(LONG - OFFSET)) + F.lit(OFFSET).cast("long"))


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x`` of the rows that hold numbers alone and have the most frequent length."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & sound).select(F.col(key), whole_entries(F.col(vector)).alias("x"))
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("x") == (size["size"] if size else 0))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _centred(x: np.ndarray, low: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """Vectors less the mean, whose whole parts are taken off as whole numbers where no long overflows."""
    if np.abs(x.astype(float)).max(initial=0) < 2**62:
        return (x - low).astype(float) - fraction
    return x.astype(float) - low.astype(float) - fraction


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, exact."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, 0)
                n += len(x)
                own = x.sum(axis=0) if np.abs(x.astype(float)).max(initial=0) < 2**48 else x.astype(object).sum(axis=0)
                total = total + own.astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["place", "n", "total"])

    rows = fit.mapInArrow(added, "place int, n long, total decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # one row a dimension
    by_place = {r.place: r for r in rows}
    return (by_place[0].n if rows else 0), [int(by_place[k].total) for k in range(len(rows))]


def added_products(fit: DataFrame, values: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of ``values`` of all vectors: a row a task and entry, added up by entry."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = values(_matrix(batch, 0))
                total += y.sum(axis=0)
                products += y.T @ y
        i, j = np.triu_indices(width)
        i, j, v = np.concatenate([np.full(width, -1), i]), np.concatenate([np.arange(width), j]), np.concatenate([total, products[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["i", "j", "v"])

    total, products = np.zeros(width), np.zeros((width, width))
    for r in fit.mapInArrow(added, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width squared rows at most
        if r.i < 0:
            total[r.j] = r.v
        else:
            products[r.i, r.j] = products[r.j, r.i] = r.v
    return total, products


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error``: lists have an entry a component.

    ``n``: distinct vectors of the fit; ``deviation``: squared distance from the mean times n squared, exact.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, key, vector)
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(fit)
    d = len(sums)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n long, deviation long, whitened array<double>"
    if not n:
        return rows.limit(0).selectExpr(f"`{key}`", "0L n", "0L deviation", "array(0D) whitened", "array(0D) explained", "0D identity_error")
    # The mean as a whole part and a fraction: differences from it lose nothing.
    part = [divmod(s, n) for s in sums]
    low, fraction = np.array([min(q, LONG) for q, _ in part], np.int64), np.array([r / n for _, r in part])
    rest = np.array([r for _, r in part], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return _centred(x, low, fraction)

    covariance = added_products(fit, centred, d)[1] / n
    e, w = components(covariance, most)
    held = e > LEAST * max(e.max(initial=0.0), 0.0)
    e, w = e[held], w[:, held]
    explained = e / np.trace(covariance) if len(e) else e
    shared = spark.sparkContext.broadcast((low, fraction, rest, w / np.sqrt(e)))

    def projected(x: np.ndarray) -> np.ndarray:
        at, part, _, axes = shared.value
        return _centred(x, at, part) @ axes

    total, products = added_products(fit, projected, len(e))
    # The mean is of the order of rounding; products are of values centred by it.
    error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(len(e))).max(initial=0.0))

    def deviations(x: np.ndarray) -> list[int | None]:
        at, _, over, _ = shared.value
        about = np.abs(x.astype(float) - at) * n + n
        if (about**2).sum(axis=1).max(initial=0) < 2.0**62:
            return ((n * (x - at) - over) ** 2).sum(axis=1).tolist()
        exact = [sum((n * (int(v) - int(a)) - int(o)) ** 2 for v, a, o in zip(row, at, over, strict=True)) for row in x.tolist()]
        return [v if v <= LONG else None for v in exact]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, 1)
                z = projected(x)
                ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n] * len(z), pa.int64()), pa.array(deviations(x), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], [key, "n", "deviation", "whitened"])

    out = rows.mapInArrow(made, schema)
    return out.withColumns({"explained": F.array(*[F.lit(float(v)) for v in explained]).cast("array<double>"), "identity_error": F.lit(error)})


def listed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row a vector and component, components from 1."""
    rows = whitened(vectors, key, vector, most)
    long = rows.select(key, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return long.select(key, (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("k") + 1).alias("explained"), "identity_error")
