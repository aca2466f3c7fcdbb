"""Linear models per series (ML1, ML2, ML17): sufficient statistics in Spark,
a small p x p solve in a pandas UDF.

The expensive part, sum over rows of the outer product ``z z'`` with
``z = [1, x_1..x_p, y]``, runs as a Spark aggregation: each row contributes
its flattened upper triangle as a vector and ``Summarizer.sum`` adds them per
group with partial (map-side) aggregation, so a series holding a third of
all rows is still combined in parallel before the shuffle. Only the
resulting ``O(p^2)`` arrays reach Python, in Arrow batches, where NumPy
solves all groups of a batch at once.

Features are centred per series (``center``) before the products are formed:
a ridge is shift-invariant, and centring keeps raw cross-products of values
around 1e7 from losing digits. Trees get the raw features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = np.finfo(float).eps


# ------------------------------------------------------------ array helpers
def upper_outer(z: Column, q: int | None = None) -> Column:
    """Flattened upper triangle (row-major, diagonal included) of z z'.

    With the length ``q`` known at plan time the products are spelled out
    as one array of element products (code-generated); otherwise nested
    higher-order functions are used (interpreted, ~2x slower)."""
    if q is not None:
        iu = np.triu_indices(q)
        return F.array(*[z[int(i)] * z[int(j)] for i, j in zip(*iu)])
    n = F.size(z)
    return F.flatten(F.transform(z, lambda a, i: F.transform(F.slice(z, i + 1, n - i),
                                                              lambda b: a * b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def vec_sum(df: DataFrame, keys: Sequence[str], arr: Column, name: str) -> DataFrame:
    """Element-wise sum of an array column per group (partial aggregation)."""
    g = df.groupBy(*keys).agg(Summarizer.sum(array_to_vector(arr)).alias("_v"))
    return g.select(*keys, vector_to_array("_v").alias(name))


def gram(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", name: str = "gram",
         p: int | None = None) -> DataFrame:
    """Upper-triangle sums of ``[1, x, y][1, x, y]'`` per group (``p`` = the
    length of ``x`` when known at plan time)."""
    z = F.concat(F.array(F.lit(1.0)), F.col(x), F.array(F.col(y).cast("double")))
    d = df.withColumn("_z", z)
    return vec_sum(d, keys, upper_outer(F.col("_z"), None if p is None else p + 2), name)


def unpack_upper(flat: np.ndarray, q: int) -> np.ndarray:
    """(m, q(q+1)/2) upper triangles -> (m, q, q) symmetric matrices."""
    iu = np.triu_indices(q)
    out = np.zeros((flat.shape[0], q, q))
    out[:, iu[0], iu[1]] = flat
    out[:, iu[1], iu[0]] = flat
    return out


def _stack(s: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=float) for v in s])


def materialize(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reliable checkpoint (shared ``spark.checkpoint.dir``) of a reused
    frame, partitioned by ``keys``. AQE sizes the partitions from the data."""
    from mensura.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartition(*keys) if keys else df).checkpoint(eager=True)


#: Element products that one task forms, above which a panel is spread further.
TASK_PRODUCTS = 8_000_000


def spread(df: DataFrame, keys: Sequence[str], q: int) -> DataFrame:
    """``df``, a checkpointed panel, over as many partitions as its rows times
    the products of a row of length ``q`` ask for. AQE packs partitions by
    bytes, of which a panel has few next to the work its Grams make."""
    products = df.count() * (q * (q + 1) // 2)
    parts = -(-products // TASK_PRODUCTS)
    return df.repartition(parts, *keys) if parts > 1 else df


#: Rows whose products are held at a time.
PRODUCT_ROWS = 8192


def products(z: np.ndarray) -> np.ndarray:
    """Flattened upper triangle (row-major, diagonal included) of z z' of every row of ``z``."""
    n, q = z.shape
    out = np.empty((n, q * (q + 1) // 2))
    at = 0
    for i in range(q):
        np.multiply(z[:, i:i + 1], z[:, i:], out=out[:, at:at + q - i])
        at += q - i
    return out


def prefix_ridge_solve(p: int, alpha: float, out: pa.Schema, rows: int = 4096):
    """Function for ``mapInArrow``: each row is a group with the places ``t``
    and buckets ``b`` of its training rows, and their ``[1, x, y]`` one after
    the other in ``z``. Bucket Grams are added cumulatively (fold ``k`` uses
    buckets ``<= k`` of ``K``) and every fold of a batch of groups is solved
    at once. ``rows`` bounds the folds in hand, ``PRODUCT_ROWS`` the products.
    """
    q = p + 2
    tri = q * (q + 1) // 2

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, folds = batch.column("b"), batch.column("K").to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(len(folds)), np.diff(buckets.offsets.to_numpy()))
        bucket = buckets.flatten().to_numpy(zero_copy_only=False)
        t = batch.column("t").flatten().to_numpy(zero_copy_only=False)
        z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, q)
        sums = np.zeros((len(folds), int(folds.max()), tri))
        order = np.lexsort((t, bucket, group))
        for at in range(0, len(order), PRODUCT_ROWS):
            some = order[at:at + PRODUCT_ROWS]
            starts = np.flatnonzero((np.diff(group[some], prepend=-1) != 0) | (np.diff(bucket[some], prepend=-1) != 0))
            sums[group[some][starts], bucket[some][starts]] += np.add.reduceat(products(z[some]), starts, axis=0)
        sums = np.cumsum(sums, axis=1)
        g, k = np.nonzero((sums[:, :, 0] > 0) & (np.arange(sums.shape[1]) < folds[:, None]))
        coef = ridge_from_gram(unpack_upper(sums[g, k], q), p, alpha) if len(g) else np.zeros((0, 2 * p + 2))
        columns = {c: batch.column(c).take(pa.array(g)) for c in out.names if c in batch.schema.names}
        columns |= {"k": pa.array(k.astype(np.int32)), "p": pa.array(np.full(len(g), p, dtype=np.int32)),
                    "coef": pa.ListArray.from_arrays(
                        pa.array(np.arange(0, coef.size + 1, 2 * p + 2, dtype=np.int32)), pa.array(coef.ravel()))}
        return pa.RecordBatch.from_arrays([columns[c].cast(out.field(c).type) for c in out.names], schema=out)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            most = max(batch.column("K").to_numpy(zero_copy_only=False).max(), 1)
            step = max(1, rows // int(most))
            for at in range(0, batch.num_rows, step):
                yield solve(batch.slice(at, step))

    return fn


# ------------------------------------------------------------ centring / standardising
def center(df: DataFrame, p: int, keys: Sequence[str] = ("series_id",), x: str = "x") -> DataFrame:
    """Array column ``x`` (length ``p``) minus its mean per series (nulls
    kept). Only for ridge, whose predictions a shift does not change; models
    that a shift can change get the raw features, since the mean looks
    ahead."""
    w = Window.partitionBy(*keys)
    return df.withColumn(x, F.array(*[F.col(x)[i] - F.avg(F.col(x)[i]).over(w) for i in range(p)]))


def standardize(train: DataFrame, apply_to: DataFrame, cols: Sequence[str],
                keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """ML1: scale ``apply_to`` with the mean and *population* sigma of
    ``train`` per group; sigma = 0 is replaced by 1."""
    stats = train.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    j = apply_to.join(stats, list(keys), "left")
    out = {}
    for c in cols:
        sd = F.col(f"_sd_{c}")
        sd = F.when(sd.isNull() | (sd <= F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs(F.col(f"_mu_{c}")))),
                    F.lit(1.0)).otherwise(sd)
        out[c] = (F.col(c) - F.col(f"_mu_{c}")) / sd
    return j.withColumns(out).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def fold_scaler_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("series_id",),
                      order: str = "period") -> DataFrame:
    """ML1 per fold: mean and population sigma of each column over the rows
    strictly before each row, i.e. the scaler a fold cut at that row is
    fitted with. An expanding window per series, no (fold x row) expansion;
    adds ``{c}_mu`` and ``{c}_sd`` (sigma 0 -> 1, as the scaler does)."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for c in cols:
        mu, sd = F.avg(c).over(frame), F.stddev_pop(c).over(frame)
        out[f"{c}_mu"] = mu
        out[f"{c}_sd"] = F.when(sd <= F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs(mu)), F.lit(1.0)).otherwise(sd)
    return df.withColumns(out)


# ------------------------------------------------------------ ridge
def ridge_from_gram(G: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Ridge on standardised features (train mean, population sigma),
    unpenalised intercept, from stacked Gram matrices of ``[1, x, y]``.

    Returns (m, 2p+2): ``[b0, beta_1..beta_p, w_1..w_p, n]`` with ``beta`` in
    the units of the (centred) features and ``w`` the standardised
    coefficients.
    """
    n = G[:, 0, 0]
    mu = G[:, 0, 1:p + 1] / n[:, None]
    ybar = G[:, 0, p + 1] / n
    C = G[:, 1:p + 1, 1:p + 1] - n[:, None, None] * mu[:, :, None] * mu[:, None, :]
    cxy = G[:, 1:p + 1, p + 1] - n[:, None] * mu * ybar[:, None]
    var = np.clip(np.diagonal(C, axis1=1, axis2=2) / n[:, None], 0.0, None)
    sd = np.sqrt(var)
    const = sd <= 1e-9 * np.maximum(1.0, np.abs(mu))
    sd = np.where(const, 1.0, sd)
    C = np.where(const[:, :, None] | const[:, None, :], 0.0, C)
    cxy = np.where(const, 0.0, cxy)
    A = C / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(p)[None]
    w = np.linalg.solve(A, (cxy / sd)[..., None])[..., 0]
    beta = w / sd
    b0 = ybar - (beta * mu).sum(axis=1)
    return np.concatenate([b0[:, None], beta, w, n[:, None]], axis=1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ridge_solve(gram_col: pd.Series, p_col: pd.Series, alpha_col: pd.Series) -> pd.Series:
    """Batched ridge solve: Gram (upper triangle) -> [b0, beta(p), w_std(p), n]."""
    out = [None] * len(gram_col)
    for (p, alpha), idx in pd.DataFrame({"p": p_col, "a": alpha_col}).groupby(["p", "a"]).groups.items():
        idx = list(idx)
        flat = _stack(gram_col.iloc[idx])
        res = ridge_from_gram(unpack_upper(flat, int(p) + 2), int(p), float(alpha))
        for k, i in enumerate(idx):
            out[i] = res[k].tolist()
    return pd.Series(out)


def fit_ridge(df: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = ("series_id",),
              alpha: float = 5.0, p: int | None = None) -> DataFrame:
    """ML2: one ridge per group. Returns keys + ``coef`` =
    ``[b0, beta(p), w_std(p), n]`` (beta applies to the same ``x`` array)."""
    d = df.filter(F.col(y).isNotNull() & F.forall(F.col(x), lambda v: v.isNotNull()))
    g = gram(d, keys, x, y, p=p)
    p = F.first(F.size(F.col(x)))
    sizes = d.groupBy(*keys).agg(p.alias("p"))
    return g.join(sizes, list(keys)).select(
        *keys, "p", ridge_solve("gram", "p", F.lit(float(alpha))).alias("coef"))


def predict_linear(df: DataFrame, coef: str = "coef", x: str = "x", p: str = "p") -> Column:
    """``b0 + beta . x`` for a coefficient array from ``ridge_solve``."""
    beta = F.slice(F.col(coef), 2, F.col(p))
    return F.element_at(F.col(coef), 1) + dot(beta, F.col(x))


def fit_ridge_pooled(df: DataFrame, x: str = "x", y: str = "y", alpha: float = 5.0):
    """ML2, pooled: one ridge over all rows (all series together) with
    ``pyspark.ml`` LinearRegression (normal equations, distributed).

    Features are standardised with the pooled mean and *population* sigma;
    Spark's penalty is expressed per row and in label-sigma units, so
    ``regParam = alpha / n * sigma_y`` gives the same coefficients as the
    per-series closed form. Returns ``(intercept, beta)`` in the units of
    ``x``.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    d = df.filter(F.col(y).isNotNull() & F.forall(F.col(x), lambda v: v.isNotNull()))
    d = materialize(d.select(x, y), [])  # read by the statistics pass and the fit
    p = int(d.select(F.max(F.size(x))).first()[0])
    stats = d.select(F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sy"),
                     *[F.avg(F.col(x)[i]).alias(f"m{i}") for i in range(p)],
                     *[F.stddev_pop(F.col(x)[i]).alias(f"s{i}") for i in range(p)]).first()
    mu = np.array([stats[f"m{i}"] for i in range(p)])
    sd = np.array([stats[f"s{i}"] or 0.0 for i in range(p)])
    sd = np.where(sd <= 1e-9 * np.maximum(1.0, np.abs(mu)), 1.0, sd)
    z = F.array(*[(F.col(x)[i] - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i in range(p)])
    zd = d.select(array_to_vector(z).alias("features"), F.col(y).alias("label"))
    model = LinearRegression(solver="normal", regParam=alpha / stats["n"] * stats["sy"],
                             elasticNetParam=0.0, standardization=False).fit(zd)
    beta = np.asarray(model.coefficients.toArray()) / sd
    return float(model.intercept - beta @ mu), beta


# ------------------------------------------------------------ OLS with HAC errors
def _pinv_sym(G: np.ndarray, rcond: float = 1e-10) -> np.ndarray:
    """Pseudo-inverses of a stack of symmetric matrices."""
    lam, V = np.linalg.eigh(G)
    keep = lam > rcond * lam.max(axis=-1, keepdims=True)
    inv = np.where(keep, 1.0 / np.where(keep, lam, 1.0), 0.0)
    return (V * inv[..., None, :]) @ V.swapaxes(-1, -2)


def _by_length(p_col: pd.Series):
    """(p, positions) of the groups of a batch with p features."""
    p = p_col.to_numpy().astype(int)
    return [(int(k), np.flatnonzero(p == k)) for k in np.unique(p)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ols_solve(gram_col: pd.Series, p_col: pd.Series) -> pd.Series:
    """Minimum-norm OLS slopes on standardised, centred features from the Gram
    of ``[1, z, y_c]`` (eigen-decomposition, eigenvalues below 1e-10 of the
    largest dropped), then the flattened inverse of ``Z'Z``; a whole batch at
    once."""
    out = [None] * len(gram_col)
    for p, at in _by_length(p_col):
        G = unpack_upper(_stack(gram_col.iloc[at]), p + 2)
        n = G[:, 0, 0][:, None, None]
        inv = _pinv_sym(G[:, 1:p + 1, 1:p + 1] / n)
        w = (inv @ (G[:, 1:p + 1, p + 1:p + 2] / n))[..., 0]
        for i, row in zip(at, np.concatenate([w, (inv / n).reshape(len(at), -1)], axis=1)):
            out[i] = row.tolist()
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hac_cov(solved_col: pd.Series, meat_col: pd.Series, p_col: pd.Series) -> pd.Series:
    """Sandwich ``B S B`` with ``B = pinv(Z'Z)`` from ``ols_solve`` and the
    upper triangle of ``S``; returns the diagonal."""
    out = [None] * len(solved_col)
    for p, at in _by_length(p_col):
        B = _stack(solved_col.iloc[at])[:, p:].reshape(-1, p, p)
        V = B @ unpack_upper(_stack(meat_col.iloc[at]), p) @ B
        for i, row in zip(at, np.diagonal(V, axis1=1, axis2=2)):
            out[i] = row.tolist()
    return pd.Series(out)


def hac_ols(df: DataFrame, y: str, features: Sequence[str], keys: Sequence[str] = ("series_id",),
            order: str = "period", maxlags: int = 3) -> DataFrame:
    """ML17: OLS with Newey-West (Bartlett, ``maxlags``) standard errors.

    Per series: rows with all features and ``y`` present; features centred
    and scaled by the population sigma; slopes by minimum-norm least squares
    (rank-deficient designs allowed); scores ``g_t = z_t u_t``; meat
    ``sum g g' + sum_l (1 - l/(L+1)) (G_l + G_l')`` built as one aggregation
    of ``g g' + g h' + h g'`` with ``h_t = sum_l w_l g_{t-l}``; two-sided normal
    p-values. Returns (keys, feature, coef, std_err, z, p_value, pct_effect).
    """
    keys = list(keys)
    p = len(features)
    d = df.filter(F.col(y).isNotNull())
    for c in features:
        d = d.filter(F.col(c).isNotNull())
    wall = Window.partitionBy(*keys)
    mus = {c: F.avg(F.col(c).cast("double")).over(wall) for c in features}
    sds = {c: F.stddev_pop(F.col(c).cast("double")).over(wall) for c in features}
    z = F.array(*[((F.col(c) - mus[c]) / F.when(sds[c] > 0, sds[c]).otherwise(F.lit(1.0)))
                  for c in features])
    d = d.withColumns({"z": z, "sd": F.array(*[sds[c] for c in features]),
                       "yc": F.col(y) - F.avg(y).over(wall)})
    # used by the Gram, the residual and the sigma branches: materialise once
    d = materialize(d, keys)
    g = gram(d, keys, "z", "yc", p=p)
    sol = g.withColumn("p", F.lit(p)).withColumn("solved", ols_solve("gram", "p")).withColumn(
        "w", F.slice("solved", 1, p))
    r = d.join(sol.select(*keys, "w"), keys)
    r = r.withColumn("u", F.col("yc") - dot(F.col("z"), F.col("w")))
    r = r.withColumn("g", F.transform("z", lambda v: v * F.col("u")))
    ws = Window.partitionBy(*keys).orderBy(order)
    h = F.array_repeat(F.lit(0.0), p)
    for lag in range(1, maxlags + 1):
        wl = 1.0 - lag / (maxlags + 1.0)
        gl = F.coalesce(F.lag("g", lag).over(ws), F.array_repeat(F.lit(0.0), p))
        h = F.zip_with(h, gl, _weighted_add(wl))
    r = r.withColumn("h", h)
    # symmetric: the upper triangle of g g' + g h' + h g', spelled out for code generation
    gc, hc = F.col("g"), F.col("h")
    contrib = F.array(*[gc[int(i)] * gc[int(j)] + gc[int(i)] * hc[int(j)] + hc[int(i)] * gc[int(j)]
                        for i, j in zip(*np.triu_indices(p))])
    meat = vec_sum(r, keys, contrib, "meat")
    sd = d.groupBy(*keys).agg(F.first("sd").alias("sd"))
    res = sol.join(meat, keys).join(sd, keys).withColumn("vdiag", hac_cov("solved", "meat", "p"))
    feats = F.array(*[F.lit(c) for c in features])
    rows = res.select(*keys, F.posexplode(feats).alias("i", "feature"), "w", "vdiag", "sd")
    sdi = F.col("sd")[F.col("i")]
    scale = F.when(sdi > 0, sdi).otherwise(F.lit(1.0))
    coef = F.col("w")[F.col("i")] / scale
    se = F.sqrt(F.col("vdiag")[F.col("i")]) / scale
    out = rows.select(*keys, "feature", coef.alias("coef"), se.alias("std_err"))
    out = out.withColumn("z", F.try_divide(F.col("coef"), F.col("std_err")))
    # two-sided normal p-value: erfc(|z| / sqrt 2)
    out = out.withColumn("p_value", _erfc(F.abs(F.col("z")) / F.lit(np.sqrt(2.0))))
    return out.withColumn("pct_effect", F.expm1("coef") * 100)


def _weighted_add(wl: float):
    return lambda a, b: a + F.lit(wl) * b


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    from math import erfc
    return x.map(lambda v: erfc(v) if v == v else float("nan"))
