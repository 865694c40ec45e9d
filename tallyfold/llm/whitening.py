"""Whitening of embeddings by shifted CholeskyQR.

Vectors are whole numbers: x = floor(64 c) + 1000000 for each entry c.  Of the distinct vectors, less their
mean, a QR factorisation is made without ever keeping Q: each pass goes over the vectors, solves with the
triangular factors found so far, and adds up the Gram matrix of the result; its Cholesky factor is the
next one.  The first pass adds a shift to the diagonal, so that the factor exists however
ill-conditioned the vectors are; further passes make the columns orthogonal to double precision.  The
product R of the factors has the singular values and right singular vectors of all the vectors.

Tasks hand on one d by d matrix each, in rows that are added up by Spark; the driver gets one such matrix
a pass, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import claim, cut, prepare

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes of the factorisation at most; well-conditioned vectors need three.
PASSES = 8
#: Largest entry of the last Gram matrix less the identity, times the number of dimensions.
ORTHOGONAL = 1e-13
#: Singular values below this share of the largest are those of no component.
RANK = 1e-11
UNIT = float(np.finfo(float).eps) / 2


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers that 64-bit steps can hold."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**55))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + OFFSET)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """Number and exact sums of the vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.floor = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the whole part of the difference is exact."""
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n x - S, exact; None where it is no 64-bit number."""
        whole = x - self.floor
        most = (int(np.abs(whole).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((whole * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((whole.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor in turn, by substitution."""
    out = np.asfortranarray(rows, dtype=float)
    for r in factors:
        for j in range(len(r)):
            if j:
                out[:, j] -= out[:, :j] @ r[:j, j]
            out[:, j] /= r[j, j]
    return out


def _gram(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all vectors of the outer products of ``rows_of`` them, a row of the matrix at a time."""

    def partial(batches):
        claim(__name__)
        total = np.zeros((width, width))
        for batch in batches:
            made = rows_of(_matrix(batch.column(0), d))
            total += made.T @ made
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], names=["i", "row"])

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for row in table["row"].chunks:
            total += _matrix(row, width).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total])})

    schema = "i int, row array<double>"
    found = fit.mapInArrow(partial, schema).groupBy("i").applyInArrow(added, schema).collect()
    out = np.zeros((width, width))
    for r in found:
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Number of vectors and exact sums of each dimension."""

    def partial(batches):
        claim(__name__)
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & (2**31 - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = fit.mapInArrow(partial, "i int, n long, high long, low long").groupBy("i")
    found = parts.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("i").collect()
    return Centre(found[0]["n"], [int(r["high"]) * 2**31 + int(r["low"]) for r in found])


def triangular_factor(fit: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """R of the centred vectors, by passes of shifted CholeskyQR."""
    factors: list[np.ndarray] = []
    total = np.eye(d)
    for number in range(PASSES):
        gram = _gram(fit, d, lambda x: solved(centre.centred(x), factors), d)
        off = np.abs(gram - np.eye(d)).max()
        if not gram.any() or number and off <= ORTHOGONAL * d:
            break
        shift = 11 * (centre.n * d + d * (d + 1)) * UNIT * np.trace(gram)
        try:
            lower = np.linalg.cholesky(gram + np.eye(d) * (0 if number else shift))
        except np.linalg.LinAlgError:  # vectors that do not span all dimensions
            lower = np.linalg.cholesky(gram + np.eye(d) * shift)
        factors.append(lower.T)
        total = lower.T @ total
    # What the last pass leaves: nothing where columns are orthogonal; else, as no factor makes them so, its root.
    values, vectors = np.linalg.eigh(gram)
    return (vectors * np.sqrt(np.maximum(values, 0))).T @ total


def whitening(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """``keep`` columns, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` for each row with
    a vector and each of the first ``components``.

    The fit is over the distinct vectors: ``n`` of them with sums S; covariances have divisor n.
    ``deviation`` is the exact sum of squares of n x - S (null beyond 64 bits), ``whitened`` the centred
    vector along the component's unit vector (its largest entry is positive) over the root of its variance,
    ``explained`` that variance's share, ``identity_error`` the largest entry of the whitened covariance less the
    identity.  Rows whose vector is null or has a null, non-finite or immense (from 2^55) entry are left
    out, as are those of another length than most distinct vectors (the longer of equally frequent ones).  Equal rows count once in
    the fit and each give rows.  Components without variance are left out: a table of one distinct vector
    gives no rows, nor does an empty one.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != vector]
    made = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    if clash := {c.lower() for c in keep} & {c for c, _ in made}:
        raise ValueError(f"columns with names of results: {sorted(clash)}")
    prepare(df.sparkSession)
    x = "x"
    while x in {c.lower() for c in keep}:
        x += "_"
    rows = df.where(usable(F.col(vector))).select(whole(F.col(vector)).alias(x), *keep)
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, t) for c, t in made]])
    vectors = cut(rows.select(x).distinct(), "vectors")
    lengths = vectors.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    fit = vectors.where(F.size(x) == d)
    centre = centre_of(fit, d)
    _, singular, right = np.linalg.svd(triangular_factor(fit, d, centre))
    count = int((singular[:components] > RANK * singular[0]).sum()) if singular[0] > 0 else 0
    if not count:
        return df.sparkSession.createDataFrame([], schema)
    axes = right[:count] * np.sign(right[np.arange(count), np.abs(right[:count]).argmax(axis=1)])[:, None]
    explained = (singular[:count] / np.linalg.norm(singular)) ** 2
    onto = (axes / (singular[:count, None] / np.sqrt(centre.n))).T
    both = _gram(fit, d, lambda x: np.column_stack([centre.centred(x) @ onto, np.ones(len(x))]), count + 1) / centre.n
    error = float(np.abs(both[:-1, :-1] - np.outer(both[-1, :-1], both[-1, :-1]) - np.eye(count)).max())
    arrow = to_arrow_schema(schema)

    def project(batches):
        claim(__name__)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            place = pa.array(np.repeat(np.arange(len(x)), count))
            new = [
                np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), np.full(len(x) * count, centre.n), pa.array(centre.deviations(x), pa.int64()).take(place),
                (centre.centred(x) @ onto).ravel(), np.tile(explained, len(x)), np.full(len(x) * count, error),
            ]
            yield pa.RecordBatch.from_arrays([c.take(place) for c in batch.columns[1:]] + [c if isinstance(c, pa.Array) else pa.array(c) for c in new], names=arrow.names)

    return rows.where(F.size(x) == d).mapInArrow(project, schema)
