"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The fit list X holds each distinct integer vector once, one row each, centred
by its mean. Starting from a unit vector v1, the products X v and X' u take
turns over the stored fit list and give orthonormal v's and u's that turn X
into a small upper bidiagonal matrix. Every new vector is made orthogonal to
all earlier ones (twice). A u has as many entries as there are rows and is
never gathered: since every u is X w for some w as long as a row, a task makes
the entries of its own rows again, and only sums as long as a row, or as the
list of steps, come back. The singular values of the bidiagonal matrix over
sqrt(n) are the standard deviations along the components.

A Krylov space shows one direction of each repeated deviation. So when the
asked components stand, they are locked and a new start orthogonal to them is
followed until its best deviation is known to be smaller than the last one
asked for; if it is not, it joins them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import stage_table
from mensura.llm.vectors import SCALE, integer_codes, matrix

COMPONENTS = 4
#: A singular vector stands when its residual is so small against the largest singular value.
TOLERANCE = 1e-13
#: Rows that a task multiplies at a time.
CHUNK = 8192
#: Less than this against the largest value is rounding.
_NOTHING = 1e-14
#: Values so close, relatively, count as equal.
_EQUAL = 1e-9
_TEN = 10**18


def summed(fit: DataFrame, dim: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what ``make`` gives for a chunk of integer rows:
    one array of doubles per task, added up by place in Spark."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = make(matrix(batch.slice(at, CHUNK).column("code"), dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

    got = (fit.select("code").mapInArrow(parts, "sums array<double>")
           .select(F.posexplode("sums").alias("at", "value"))
           .groupBy("at").agg(F.sum("value").alias("value")).toPandas())
    return got.sort_values("at")["value"].to_numpy(dtype=np.float64)


def exact_moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[int]]:
    """Number of rows, and per dimension the exact sums of x and x * x."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, [0] * dim, [0] * dim
        for batch in batches:
            x = matrix(batch.column("code"), dim)
            if not len(x):
                continue
            n += len(x)
            small = float(np.abs(x).max()) ** 2 * len(x) < 2.0**62  # else Python's own integers
            y = x if small else x.astype(object)
            first = [a + int(b) for a, b in zip(first, y.sum(axis=0))]
            second = [a + int(b) for a, b in zip(second, (y * y).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()),
                "first": pa.array([str(a) for a in first]),
                "high": pa.array([str(b // _TEN) for b in second]), "low": pa.array([b % _TEN for b in second], pa.int64())})

    # squares in two parts: their sum may need more than 38 digits
    rows = (fit.select("code").mapInArrow(parts, "at int, n bigint, first string, high string, low bigint")
            .groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
                                                        for c in ("first", "high", "low")]).collect())
    rows.sort(key=lambda r: r["at"])
    return rows[0]["n"], [int(r["first"]) for r in rows], [int(r["high"]) * _TEN + int(r["low"]) for r in rows]


@dataclass
class Whitening:
    """What ``fit_whitening`` finds for vectors of one length."""

    dim: int
    n: int
    sums: list[int]
    #: sum over dimensions of the exact variances, times n squared
    trace: int
    #: one row per component, falling deviations
    components: np.ndarray
    eigenvalues: np.ndarray
    #: products with the data taken to find them
    steps: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows: rows x components."""
        centred = x.astype(np.float64) - np.array([s / self.n for s in self.sums])
        return centred @ self.components.T / np.sqrt(self.eigenvalues)


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


class Bidiagonal:
    """Alternating products over the centred rows of ``fit``."""

    def __init__(self, fit: DataFrame, dim: int, mean: np.ndarray, seed: int = 11):
        self.fit, self.dim, self.mean, self.products = fit, dim, mean, 0
        self.random = np.random.default_rng(seed)

    def rows(self, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        mean = self.mean
        self.products += 1
        return summed(self.fit, self.dim, lambda x: make(x.astype(np.float64) - mean))

    def left(self, w: np.ndarray, earlier: np.ndarray, images: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """u = X w made orthogonal to the u's of ``earlier``, whose X' u are
        ``images``: its w, its norm and its X' u."""
        k = len(earlier)
        if k:
            # X w: how much of it lies along the earlier u's
            along = self.rows(lambda x: (x @ earlier.T).T @ (x @ w))
            w = w - along @ earlier

        # X' u, with the second look at the earlier ones in the same pass
        def both(x: np.ndarray) -> np.ndarray:
            u = x @ w
            old = x @ earlier.T if k else np.empty((len(x), 0))
            return np.concatenate([[u @ u], old.T @ u, x.T @ u])

        got = self.rows(both)
        square, along, back = got[0], got[1:1 + k], got[1 + k:]
        if k:
            w = w - along @ earlier
            back = back - along @ images
            square = max(square - along @ along, 0.0)
        return w, float(np.sqrt(square)), back

    def run(self, locked: np.ndarray, done: Callable[[np.ndarray, np.ndarray], bool]
            ) -> tuple[np.ndarray, np.ndarray]:
        """Singular values and right vectors (rows) of X on the vectors
        orthogonal to ``locked``, falling; stops when ``done`` (of the values
        and their residuals) says so, or when the space is exhausted."""
        most = self.dim - len(locked)
        v, w, images = np.empty((3, 0, self.dim))
        alphas: list[float] = []
        betas: list[float] = []
        start = _orthogonal(self.random.standard_normal(self.dim), locked)
        fresh = start / np.linalg.norm(start)
        scale = 0.0
        while True:
            v = np.vstack([v, fresh])
            image, alpha, back = self.left(fresh, w, images)
            scale = max(scale, alpha)
            if alpha <= _NOTHING * scale:  # X takes v to what is there already: no new u
                image, alpha, back = np.zeros(self.dim), 0.0, np.zeros(self.dim)
            else:
                image, back = image / alpha, back / alpha
            alphas.append(alpha)
            w, images = np.vstack([w, image]), np.vstack([images, back])
            basis = np.vstack([locked, v])
            rest = _orthogonal(back, basis)
            beta = float(np.linalg.norm(rest))
            scale = max(scale, beta)
            if beta <= _NOTHING * scale:  # the space of this start is complete: on with another
                rest, beta = _orthogonal(self.random.standard_normal(self.dim), basis), 0.0
            p, values, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if len(v) == most or done(values, beta * np.abs(p[-1])):
                return values, q @ v
            betas.append(beta)
            fresh = _orthogonal(rest / np.linalg.norm(rest), basis)
            fresh /= np.linalg.norm(fresh)


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of the rows of ``fit`` (``code``: ``dim`` 64-bit
    integers each), or None if they do not vary."""
    n, sums, squares = exact_moments(fit, dim)
    trace = sum(n * b - a * a for a, b in zip(sums, squares))
    if trace <= 0:
        return None
    work = Bidiagonal(fit, dim, np.array([s / n for s in sums]))
    wanted = min(components, dim)
    values, vectors = np.empty(0), np.empty((0, dim))
    nothing = np.sqrt(trace / n) * 1e-12  # trace / n: the sum of squares of all entries of X

    def first(found: np.ndarray, residuals: np.ndarray) -> bool:
        return len(found) > wanted and bool((residuals[:wanted] <= TOLERANCE * found[0]).all())

    def another(found: np.ndarray, residuals: np.ndarray) -> bool:
        """Its best is surely smaller than the last one asked for, or stands."""
        last = values[wanted - 1] * (1 - _EQUAL)
        return (len(found) > 2 and residuals[0] <= 1e-3 * found[0] and found[0] + residuals[0] < last) \
            or residuals[0] <= TOLERANCE * values[0]

    while len(values) < dim:
        more, right = work.run(vectors, first if not len(values) else another)
        whole = len(more) == dim - len(values)  # nothing is left that this run has not seen
        if len(values) and more[0] <= values[wanted - 1] * (1 + _EQUAL):
            break
        n_more = wanted if whole or not len(values) else 1
        values, vectors = np.concatenate([values, more[:n_more]]), np.vstack([vectors, right[:n_more]])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
        if whole or values[wanted - 1] <= nothing:
            break
    keep = values[:wanted] > nothing
    return Whitening(dim, n, sums, trace, vectors[:wanted][keep], values[:wanted][keep] ** 2 / n, work.products)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus
    the identity; centred before multiplying."""
    dim, k = model.dim, len(model.eigenvalues)
    mean = summed(fit, dim, lambda x: model.project(x).sum(axis=0)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        y = model.project(x) - mean
        return (y.T @ y).ravel()

    return float(np.abs(summed(fit, dim, products).reshape(k, k) / model.n - np.eye(k)).max())


_COLUMNS = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
            "identity_error double, eigenvalue double, distance double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened coordinates of every vector on the leading components.

    ``vectors``: ``vec_id`` and ``embedding``; components count as
    floor(``scale`` * x). Rows whose embedding is null, or holds null, NaN or
    infinite entries, take no part; a null ``vec_id`` stays null. Other
    columns are ignored. One row per vector and component: ``vec_id``,
    ``component`` (from 1), ``n`` (distinct vectors), ``deviation`` (exact sum
    over dimensions of (n * x - S)^2; null if it needs more than 64 bits),
    ``whitened``, ``explained`` (share of the variance), ``identity_error``;
    and ``eigenvalue`` and ``distance`` (the deviation over n * n, as double).

    Repeated vectors count once in the fit and come back as often as they
    are there. Vectors of different lengths are fitted apart, a job each.
    Directions without variance are no components, so vectors that do not
    vary (one distinct vector, length 0, an empty table) give no rows. Long
    vectors cost memory in proportion to length times steps, not to rows.
    """
    rows = stage_table(integer_codes(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
                                     ["vec_id"], scale), "codes")
    fits = stage_table(rows.select("dim", "code").distinct(), "fit")
    out = None
    for dim in [r["dim"] for r in fits.select("dim").distinct().orderBy("dim").collect()]:
        fit = fits.filter(F.col("dim") == dim)
        model = fit_whitening(fit, dim, components) if dim else None
        if model is None:
            continue
        part = _coordinates(rows.filter(F.col("dim") == dim), model, identity_error(fit, model))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], _COLUMNS)


def _coordinates(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    n, k = model.n, len(model.eigenvalues)
    sums = np.array(model.sums, dtype=object)
    explained = model.eigenvalues / (model.trace / (n * n))
    most = max(abs(s) for s in model.sums)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, CHUNK):
                batch = big.slice(at, CHUNK)
                x = matrix(batch.column("code"), model.dim)
                spread = float(np.abs(x).max()) * n + most
                if spread * spread * model.dim < 2.0**62:
                    off = x * n - sums.astype(np.int64)
                    exact = (off * off).sum(axis=1).tolist()
                else:
                    off = x.astype(object) * n - sums
                    exact = [int(e) for e in (off * off).sum(axis=1)]
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    "n": pa.array(np.full(len(each), n), pa.int64()),
                    "deviation": pa.array([e if e < 2**63 else None for e in exact], pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(model.project(x).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(each), error)),
                    "eigenvalue": pa.array(np.tile(model.eigenvalues, len(x))),
                    "distance": pa.array([e / (n * n) for e in exact], pa.float64()).take(pa.array(each))})

    return rows.select("vec_id", "code").mapInArrow(coordinates, _COLUMNS)
