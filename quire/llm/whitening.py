"""Embedding whitening by shifted CholeskyQR.

Rows are centred by exact sums of whole numbers. Each pass over them adds up the Gram matrix of the
rows divided by the triangular factors found so far; its Cholesky factor, with a shift on the
diagonal in the first pass or where rounding made the matrix indefinite, is the next factor. The
factors multiply to the R of a QR decomposition, and its singular values and right vectors are those
of the centred rows: the whitening components. Only d x d matrices leave the tasks, one for each
batch, added up in a tree; rows are never together, and the covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components that are returned; passes at most; how far, for each dimension, the last Gram matrix may be from a projection.
COMPONENTS, PASSES, NEARLY = 32, 8, 1e-14
#: Shares of the trace below which a component has no variance.
NOTHING = 1e-13
#: Rows for each Gram matrix.
BATCH = 4096


@dataclass
class Whitening:
    """n rows, their sums, the right singular vectors by falling eigenvalue (as columns), the eigenvalues, and
    their sum."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def fixed_point(vector: Column) -> Column:
    """The entries as whole numbers: floor(SCALE * entry) + OFFSET."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + OFFSET)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null and has finite entries only, as many as most rows have (of a tie, more)."""
    v = F.col(column)
    finite = vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False)))
    sizes = finite.groupBy(F.size(v).alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return finite.filter(F.size(v) == (most["d"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q with Q @ upper = rows, column by column."""
    q = np.empty_like(rows)
    for j in range(rows.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def _summed(x: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` numbers that ``of`` gives for each batch of rows of ``x`` (column x).

    Batches are added up within their task, tasks in as many groups as the square root of the number
    of shuffle partitions; the driver adds the groups.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for b in batches:
            for c in range(0, len(b), BATCH):
                total += of(_matrix(b.column(0).slice(c, BATCH)))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += _matrix(b.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    sums = x.mapInArrow(partial, "v array<double>")
    groups = max(1, int(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    return np.sum([r.v for r in sums.repartition(groups).mapInArrow(added, "v array<double>").collect()], axis=0)


def fit(x: DataFrame) -> Whitening | None:
    """The whitening of the rows of ``x`` (column x of whole numbers, equally many in each); None for no rows."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    row = x.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(d)]).first()
    n, sums = row["n"], np.array([row[f"s{j}"] for j in range(d)], np.int64)
    factors: list[np.ndarray] = []
    whole, trace = np.eye(d), 0.0
    for k in range(PASSES + 1):
        g = _summed(x, lambda rows, found=tuple(factors): _gram((rows * n - sums) / n, found), d * d).reshape(d, d)
        g = (g + g.T) / 2
        if not factors:
            trace = float(np.trace(g)) / n
        if k == PASSES or trace == 0 or (factors and np.abs(g @ g - g).max() < NEARLY * d):
            break
        factors.append(_cholesky(g, n, shifted=not factors))
        whole = factors[-1] @ whole
    # rows = Q @ whole, and Q's Gram matrix is g: the identity, but for directions without variance
    inner, turn = np.linalg.eigh(g)
    _, singular, right = np.linalg.svd(np.sqrt(np.maximum(inner, 0))[:, None] * turn.T @ whole)
    return Whitening(n, sums, right.T, singular**2 / n, trace)


def _gram(rows: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    for upper in factors:
        rows = _solved(rows, upper)
    return (rows.T @ rows).ravel()


def _cholesky(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper factor of ``g``, or of it with a shift by the rounding of n rows if asked for or needed."""
    d, eps = len(g), np.finfo(float).eps
    shift = 11 * (n * d + d * (d + 1)) * eps * float(np.linalg.norm(g, 2))
    shift = min(shift, 1e-6 * float(np.trace(g)))
    for times in ([1.0] if shifted else [0.0, 1.0]) + [10.0, 100.0, 1e4]:
        try:
            return np.linalg.cholesky(g + times * shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    return np.diag(np.sqrt(np.maximum(np.diag(g), shift) + shift))


def _projected(found: Whitening, k: int) -> Callable[[np.ndarray], np.ndarray]:
    with np.errstate(divide="ignore"):
        scaled = found.vectors[:, :k] / np.sqrt(found.values[:k])
    return lambda rows: (rows * found.n - found.sums) / found.n @ scaled


def whiten(vectors: DataFrame, column: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row of
    ``vectors`` with a usable vector, and each of its first ``components`` components.

    Left out are rows whose vector is null, empty, or holds null or non-finite entries; a vector of
    another size than most of them lacks entries and goes, too. Repeated rows count as often as they
    are there; a null id stays null. ``deviation`` is null where it exceeds a long. A component
    without variance has whitened null, and explained 0, or null where nothing varies. An empty table,
    or one without usable vectors, gives none.
    """
    kind = vectors.schema[ident].dataType.simpleString()
    schema = f"{ident} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = usable(vectors.select(ident, column), column).select(F.col(ident), fixed_point(F.col(column)).alias("x"))
    found = fit(x.select("x"))
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, len(found.values))
    live = int((found.values[:k] > NOTHING * found.trace).sum())
    of, error = _projected(found, live), None
    if live:
        moments = _summed(x.select("x"), lambda rows: np.concatenate([(z := of(rows)).sum(axis=0), (z.T @ z).ravel()]), live * (live + 1))
        mean = moments[:live] / found.n
        error = float(np.abs(moments[live:].reshape(live, live) / found.n - np.outer(mean, mean) - np.eye(live)).max())
    explained = [float(e / found.trace) if found.trace else None for e in found.values[:k]]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in range(0, len(b), BATCH):
                part = b.slice(c, BATCH)
                rows = _matrix(part.column(1))
                m = len(rows)
                z = np.full((m, k), np.nan)
                z[:, :live] = of(rows)
                apart = rows * found.n - found.sums
                fits = (apart.astype(float) ** 2).sum(axis=1) < 9.2e18
                deviation = np.where(fits, (apart**2).sum(axis=1), 0)
                numbers = np.tile(np.arange(1, k + 1), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(numbers, pa.int32()), pa.array(np.full(m * k, found.n)),
                        pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)), pa.array(z.ravel(), mask=numbers > live),
                        pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=[ident, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(rows_of, schema)
