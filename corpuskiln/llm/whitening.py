"""Whitening of embeddings by pivoted Cholesky of their centred scatter and one-sided Jacobi on the factor.

Entries become integers, so that sums and the scatter are exact. Three passes over the stored integer vectors: sums, the scatter of
the entries after the integer next to their mean is taken off, and the covariance of the whitened
vectors as proof of the result. A partition adds up its own rows, Spark adds up the partitions by
entry, and what reaches the driver is one matrix of the dimension squared. What the integer mean leaves
(less than a half) is corrected in exact integer arithmetic, so the covariance is the
true one, rounded once.

On the driver the covariance V = L L' is factored with pivots, which stops at its rank.
Jacobi rotations then make the columns of L orthogonal to each other: V itself is never formed again, so small eigenvalues keep their
relative precision. Norms of the rotated columns give the eigenvalues, the normalised columns the components.

The fit list holds each distinct vector once, so a vector that fills a third of the rows leaves the
tasks that read it as one row each. The memory of a task is one Arrow batch and one matrix.

Defined cases: rows whose vector is null or has a null or non-finite entry are left out, and so are vectors
that have not the most frequent length (of equally frequent ones the largest). Entries beyond +-``LARGEST``/64 count as
that bound. Rows of one id, and equal rows, are each kept. There are at most as many components as the covariance
has rank; a single vector, or none, has none and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.scratch import write_scratch

SCALE = 64
SHIFT = 1_000_000
LARGEST = 9e18
COMPONENTS = 16
MAX_SWEEPS = 60
EXACT = pa.decimal128(38, 0)
INT64_SAFE = HALF = 1 << 62


@dataclass
class Whitening:
    """A fitted whitening of dimension d: everything a task needs to project a vector."""

    n: int
    centre: np.ndarray  # the integer next to the mean of each dimension
    rest: list[int]  # sum of (x - centre) over the fit list, a dimension each
    components: np.ndarray  # d x k, unit columns
    eigenvalues: np.ndarray  # of the covariance, falling
    trace: float
    identity_error: float = field(default=0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n of int64 rows."""
        return (x - self.centre).astype(float) - np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exact."""
        y = x - self.centre
        largest = self.n * int(np.abs(y).max(initial=0)) + max((abs(r) for r in self.rest), default=0)
        if largest * largest * max(1, x.shape[1]) < INT64_SAFE:
            off = self.n * y - np.array(self.rest, np.int64)
            return (off * off).sum(1).tolist()
        off = self.n * y.astype(object) - np.array(self.rest, object)
        return (off * off).sum(1).tolist()


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Stored rows (vec_id, x ARRAY<BIGINT>) of all vectors that can be used, of one length."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    usable = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def integer(c):
        return F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT

    read = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("_v"))
    whole = read.filter(F.col("_v").isNotNull() & (F.size("_v") > 0)).filter(usable)
    stored = write_scratch(whole.select("vec_id", F.transform("_v", integer).alias("x")), "vectors")
    lengths = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return stored if len(lengths) < 2 else stored.filter(F.size("x") == lengths[0]["d"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _add_up(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], exact: bool) -> dict[int, int | float]:
    """Sum of ``partial`` (a flat array a batch, of a size that only depends on the dimension) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(_matrix(batch))
                total = part if total is None else total + part
        if total is None:
            return
        at = pa.array(np.arange(len(total)))
        if exact:  # two halves, so that sums of products of the largest entries fit
            halves = [divmod(int(v), HALF) for v in total]
            values = [pa.array([Decimal(h[k]) for h in halves], EXACT) for k in (0, 1)]
        else:
            values = [pa.array(total, pa.float64())]
        yield pa.RecordBatch.from_arrays([at, *values], ["at", *names])

    names = ("high", "low") if exact else ("value",)
    kind = "decimal(38,0)" if exact else "double"
    parts = rows.select("x").mapInArrow(run, ", ".join(["at bigint", *[f"{c} {kind}" for c in names]]))
    summed = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {r["at"]: int(r["high"]) * HALF + int(r["low"]) if exact else r["value"] for r in summed}


def _column_sums(x: np.ndarray) -> np.ndarray:
    safe = int(np.abs(x).max()) * len(x) < INT64_SAFE
    sums = x.sum(0) if safe else x.astype(object).sum(0)
    return np.append(np.array(sums, object), len(x))


def _scatter_of(centre: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    def scatter(x: np.ndarray) -> np.ndarray:
        low, high = int(x.min()) - int(centre.max()), int(x.max()) - int(centre.min())
        largest = max(abs(low), abs(high))
        if largest * largest * len(x) < 1 << 53:  # sums of products that floats hold exactly
            y = (x - centre).astype(float)
            return np.array((y.T @ y).astype(np.int64), object).ravel()
        y = x.astype(object) - centre.astype(object)
        return (y.T @ y).ravel()

    return scatter


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L (d x rank) with L L' = matrix, positive semidefinite; rows stay in the order of the matrix."""
    left = matrix.astype(float).copy()
    d = len(left)
    columns: list[np.ndarray] = []
    bound = d * np.finfo(float).eps * max(float(left.diagonal().max(initial=0.0)), 0.0)
    diagonal = left.diagonal().copy()
    for _ in range(d):
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= bound:
            break
        row = left[:, pivot].copy()
        for done in columns:
            row -= done * done[pivot]
        column = row / np.sqrt(diagonal[pivot])
        column[diagonal == -np.inf] = 0.0
        columns.append(column)
        diagonal = diagonal - column * column
        diagonal[pivot] = -np.inf
    return np.array(columns).T if columns else np.zeros((d, 0))


def rounds_of_pairs(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``k`` columns as rounds of disjoint pairs: one stays, the others move around a table."""
    seats = list(range(k + k % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [(seats[i], seats[-1 - i]) for i in range(len(seats) // 2)]
        pairs = [p for p in pairs if max(p) < k]
        rounds.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors) of factor factor', falling: its columns are rotated until they are orthogonal."""
    a = factor.copy()
    eps = np.finfo(float).eps
    for _ in range(MAX_SWEEPS):
        worst = 0.0
        for p, q in rounds_of_pairs(a.shape[1]):
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left**2).sum(0), (right**2).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > eps * size
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p[turn]], a[:, q[turn]] = c * left[:, turn] - s * right[:, turn], s * left[:, turn] + c * right[:, turn]
        if worst <= 4 * eps:
            break
    norms = (a**2).sum(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order], a[:, order] / np.sqrt(norms[order])


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened covariance of the fit list minus the identity, measured over all its rows.

    Each batch takes off its own mean before it multiplies; what batches differ in is added by their means.
    """
    k = len(model.eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        mean = w.mean(0)
        off = w - mean
        return np.concatenate([(off.T @ off + len(w) * np.outer(mean, mean)).ravel(), w.sum(0)])

    sums = _add_up(fit, moments, exact=False)
    total = np.array([sums[i] for i in range(k * k + k)])
    mean = total[k * k :] / model.n
    covariance = total[: k * k].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors (x); None where there is no component."""
    fit = write_scratch(vectors.select("x").distinct(), "fit-list")
    sums = _add_up(fit, _column_sums, exact=True)
    if not sums:
        return None
    d = len(sums) - 1
    n, totals = sums[d], [sums[i] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in totals]  # nearest integer
    rest = [s - n * c for s, c in zip(totals, centre, strict=True)]
    whole = np.array(centre, np.int64)
    products = _add_up(fit, _scatter_of(whole), exact=True)
    covariance = np.array(
        [[(n * products[i * d + j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)]
    )
    eigenvalues, vectors_ = one_sided_jacobi(pivoted_cholesky(covariance))
    if not len(eigenvalues):
        return None
    vectors_ = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(0), np.arange(vectors_.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(
        n, whole, rest, np.ascontiguousarray(vectors_[:, :components]), eigenvalues[:components], float(covariance.trace())
    )
    model.identity_error = _identity_error(fit, model)
    return model


def apply_whitening(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, whitened ARRAY<DOUBLE>, deviation DECIMAL(38,0)) of rows (vec_id, x); the model is one small matrix.

    A deviation beyond 38 digits is null.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            w = model.project(x)
            k = w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            deviations = [Decimal(v) if v < 10**38 else None for v in model.deviation(x)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists, pa.array(deviations, EXACT)], ["vec_id", "whitened", "deviation"]
            )

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, whitened array<double>, deviation decimal(38,0)")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact; as BIGINT it is null where 64 bits do not hold it, and ``deviation_exact`` has the digits.
    """
    vectors = integer_vectors(rows, id_col, vector_col)
    model = fit_whitening(vectors, components)
    if model is None:
        none = vectors.limit(0).select("vec_id", F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
        return _by_component(none, 0, [], 0.0)
    explained = [float(e) / model.trace for e in model.eigenvalues]
    return _by_component(apply_whitening(vectors, model), model.n, explained, model.identity_error)


def _by_component(projected: DataFrame, n: int, explained: list[float], identity_error: float) -> DataFrame:
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(identity_error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
