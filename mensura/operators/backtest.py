"""Backtests and forecasting (JN5, ML7-ML11, ML13, ML18).

Every backtest here is an expanding-window scheme: fold ``k`` trains on rows
``t < cutoff_k`` and scores rows ``cutoff_k <= t < cutoff_k + h`` with
``cutoff_k = c0 + k * step`` (per series):

* walk-forward, one step (ML8): ``c0 = n - n_test``, ``step = 1``, ``h = 1``
* rolling-origin blocks (ML7): cutoffs ``range(min_train, n - h + 1, step)``,
  fallback one cutoff ``max(1, n - h)``
* time-series k-fold (ML9): ``n_val = n div (k+1)``, ``c0 = n - k n_val``,
  ``step = h = n_val``

Ridge fits never materialise the (fold x row) expansion: each training row
goes to the bucket of the first fold it belongs to, Gram sums are taken per
bucket, and the Gram of a fold is the running sum of the buckets it includes
(``bucket <= k``). Cost per series is O(rows p^2 + folds p^2) instead of
O(rows folds p^2).

Tree models are fitted per series, all folds together (``operators.trees``).
With ``pooled`` they are pyspark.ml models over all series, one fit per fold
date on the rows of all series before it, as independent Spark jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mensura.operators import linear as lin
from mensura.operators import trees as tr
from mensura.operators.reconstruct import reconstruct

MODELS = ("ridge", "forest", "boosting")


# ------------------------------------------------------------ fold plans
def plan_walk_forward(n: Column, n_test: int) -> dict[str, Column]:
    return {"c0": n - F.lit(n_test), "step": F.lit(1), "K": F.lit(n_test), "h": F.lit(1)}


def plan_blocks(n: Column, horizon: int, min_train: int = 24, step: int = 6) -> dict[str, Column]:
    """Cutoffs ``range(min_train, n - horizon + 1, step)``; if empty, one
    cutoff at ``max(1, n - horizon)``."""
    k = F.greatest(F.lit(0), F.ceil((n - F.lit(horizon) + 1 - F.lit(min_train)) / F.lit(step))).cast("int")
    has = k > 0
    return {"c0": F.when(has, F.lit(min_train)).otherwise(F.greatest(F.lit(1), n - F.lit(horizon))),
            "step": F.when(has, F.lit(step)).otherwise(F.lit(1)),
            "K": F.when(has, k).otherwise(F.lit(1)), "h": F.lit(horizon)}


def plan_kfold(n: Column, n_splits: int = 4) -> dict[str, Column]:
    k = F.least(F.lit(n_splits), n - 1)
    n_val = F.floor(n / (k + 1)).cast("int")
    return {"c0": n - k * n_val, "step": n_val, "K": k, "h": n_val}


def with_plan(df: DataFrame, plan_fn, keys: Sequence[str], **kw) -> DataFrame:
    """Attach per-series plan columns (c0, step, K, h) computed from the
    series length ``n`` (window count, no extra shuffle)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumns(plan_fn(n, **kw))


def fold_layout(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """(keys, fold k, cutoff, n_train, first/last test t) for a planned frame."""
    f = df.select(*keys, "c0", "step", "K", "h").distinct()
    f = f.select(*keys, "c0", "step", "h", F.explode(F.sequence(F.lit(0), F.col("K") - 1)).alias("k"))
    f = f.withColumn("cutoff", F.col("c0") + F.col("k") * F.col("step"))
    # ``t`` runs 0..n-1 without holes, so the rows before a cutoff need no counting
    return f.select(
        *keys, "k", "cutoff", F.col("cutoff").cast("long").alias("n_train"), F.col("cutoff").alias("test_first_t"),
        (F.col("cutoff") + F.col("h") - 1).alias("test_last_t"))


# ------------------------------------------------------------ ridge over folds
def _bucket(t: Column) -> Column:
    return F.when(t < F.col("c0"), F.lit(0)).otherwise(
        F.floor((t - F.col("c0")) / F.col("step")).cast("int") + 1)


def fold_ridge(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", t: str = "t",
               eligible: str = "eligible", alpha: float = 5.0, p: int | None = None) -> DataFrame:
    """Ridge per (keys, fold k) under the plan columns; returns
    (keys, k, p, coef).

    A series' training rows (at most one per period, so the calendar bounds
    them) are one array; a task forms the bucket Grams of a whole Arrow batch
    of series, adds them cumulatively and solves every fold at once. A bucket
    often holds one row, whose Gram is many times the row, so rows are moved."""
    keys = list(keys)
    if p is None:
        p = int(df.select(F.max(F.size(x))).first()[0])
    tr = df.filter(F.col(eligible)).withColumn("b", _bucket(F.col(t))).filter(F.col("b") < F.col("K"))
    z = F.concat(F.array(F.lit(1.0)), F.col(x), F.array(F.col(y).cast("double")))
    of_series = tr.groupBy(*keys, "K").agg(F.collect_list(F.struct(F.col(t).alias("t"), "b", z.alias("z"))).alias("_g"))
    of_series = of_series.select(*keys, F.col("K").cast("int").alias("K"), F.col("_g.t").cast("array<long>").alias("t"),
                                 F.col("_g.b").cast("array<int>").alias("b"), F.flatten("_g.z").alias("z"))
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("k", T.IntegerType()), T.StructField("p", T.IntegerType()),
        T.StructField("coef", T.ArrayType(T.DoubleType()))])
    return of_series.mapInArrow(lin.prefix_ridge_solve(p, float(alpha), to_arrow_schema(schema)), schema)


def test_rows(df: DataFrame, t: str = "t") -> DataFrame:
    """Rows scored by some fold, with every fold index ``k`` scoring them."""
    lo = F.greatest(F.lit(0), F.ceil((F.col(t) - F.col("h") + 1 - F.col("c0")) / F.col("step")).cast("int"))
    hi = F.least(F.col("K") - 1, F.floor((F.col(t) - F.col("c0")) / F.col("step")).cast("int"))
    d = df.filter(F.col(t) >= F.col("c0")).withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_lo") <= F.col("_hi"))
    return d.withColumn("k", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def ridge_backtest(df: DataFrame, keys: Sequence[str], x="x", y="y", t="t",
                   eligible="eligible", alpha=5.0, p: int | None = None) -> DataFrame:
    """Fit per fold and score that fold's test rows: adds ``k`` and
    ``pred_target``."""
    if p is None:
        p = int(df.select(F.max(F.size(x))).first()[0])
    df = lin.center(df, p, keys, x)
    coef = fold_ridge(df, keys, x, y, t, eligible, alpha, p)
    te = test_rows(df, t).filter(F.forall(F.col(x), lambda v: v.isNotNull()))
    j = te.join(coef, [*keys, "k"])
    return j.withColumn("pred_target", lin.predict_linear(j)).drop("coef", "p")


# ------------------------------------------------------------ trees
# Tree settings of the three published model sets (trees,
# depth, minimum leaf size, feature subset per split; boosting rounds,
# depth, learning rate, row subsample, column subsample, leaf penalty).
TREE_PROFILES = {
    "delevel": {
        "forest": {"num_trees": 400, "max_depth": 5, "min_leaf": 3, "feature_subset": "all"},
        "boosting": {"num_trees": 300, "max_depth": 3, "learning_rate": 0.05, "subsample": 1.0},
    },
    "level": {
        "forest": {"num_trees": 300, "max_depth": 5, "min_leaf": 3, "feature_subset": "sqrt"},
        "boosting": {"num_trees": 150, "max_depth": 2, "learning_rate": 0.03, "subsample": 0.7},
        "boosting_colsample": {"num_trees": 200, "max_depth": 2, "learning_rate": 0.03, "subsample": 0.7,
                               "feature_subset": "0.7", "l2": 2.0},
    },
    "comparison": {
        "forest": {"num_trees": 300, "max_depth": 6, "min_leaf": 2, "feature_subset": "all"},
        "boosting": {"num_trees": 200, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.8},
        "boosting_colsample": {"num_trees": 300, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.8,
                               "feature_subset": "0.8", "l2": 2.0},
    },
}


def tree_model(kind: str, seed: int = 42, profile: str = "delevel", **params):
    """pyspark.ml regressor for ``kind`` with the settings of ``profile``;
    keyword arguments override single settings (e.g. ``num_trees``)."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    base = dict(TREE_PROFILES[profile].get(kind, TREE_PROFILES["delevel"].get(kind, {})))
    base.update({k: v for k, v in params.items() if v is not None})
    if kind == "forest":
        return RandomForestRegressor(
            numTrees=base.get("num_trees", 400), maxDepth=base.get("max_depth", 5),
            minInstancesPerNode=base.get("min_leaf", 3),
            featureSubsetStrategy=base.get("feature_subset", "all"), maxBins=256, seed=seed,
            featuresCol="features", labelCol="y")
    if kind in ("boosting", "boosting_colsample"):
        return GBTRegressor(
            maxIter=base.get("num_trees", 300), maxDepth=base.get("max_depth", 3),
            stepSize=base.get("learning_rate", 0.05),
            subsamplingRate=base.get("subsample", 1.0),
            featureSubsetStrategy=base.get("feature_subset",
                                           "0.7" if kind == "boosting_colsample" else "all"),
            maxBins=256, seed=seed, featuresCol="features", labelCol="y")
    raise ValueError(f"unknown tree model {kind}")


def tree_backtest(df: DataFrame, keys: Sequence[str], model: str, x="x", y="y", t="t",
                  eligible="eligible", group_by: Sequence[str] = (), parallelism: int = 8,
                  refit_every: int = 1, order: str = "period", **params) -> DataFrame:
    """Pooled tree fits, one per fold date (and per ``group_by`` value, e.g.
    target kind). A fold's date is the ``order`` value of its first test row;
    the fit of a date trains on the rows of all series before it and scores
    the folds of that date, so no series sees another's later months. Returns
    the scored rows with ``k`` and ``pred_target``.

    ``refit_every = r > 1`` fits once per ``r`` consecutive dates (trained
    before the first of them) and scores all ``r`` with it: still out of
    sample, ``r`` times fewer distributed fits on a large panel; the default
    1 refits at every date.
    """
    # iterative fits re-read their input many times: materialise it once in
    # the shared checkpoint folder (reliable, survives executor loss)
    complete = F.forall(F.col(x), lambda v: v.isNotNull())
    d = lin.materialize(df.withColumn("features", F.when(complete, array_to_vector(F.col(x)))), keys)
    groups = [tuple(r) for r in d.select(*group_by).distinct().collect()] if group_by else [()]
    dates = d.select(*keys, F.col(t).alias("_cut"), F.col(order).alias("_date"))
    te_all = test_rows(d, t).filter(F.forall(F.col(x), lambda v: v.isNotNull()))
    te_all = te_all.withColumn("_cut", F.col("c0") + F.col("k") * F.col("step")).join(dates, [*keys, "_cut"])
    te_all = lin.materialize(te_all.drop("_cut"), keys)
    # one date per calendar period of the panel at most
    cuts = [r[0] for r in te_all.select("_date").distinct().orderBy("_date").collect()]
    tasks = []
    for g in groups:
        cond = F.lit(True)
        for c, v in zip(group_by, g):
            cond = cond & (F.col(c) == F.lit(v))
        for i in range(0, len(cuts), refit_every):
            train = d.filter(cond & F.col(eligible) & (F.col(order) < F.lit(cuts[i])))
            test = te_all.filter(cond & F.col("_date").isin(cuts[i:i + refit_every]))
            tasks.append((train.select("features", F.col(y).alias("y")), test))
    if not tasks:
        return te_all.withColumn("pred_target", F.lit(None).cast("double")).drop("features", "_date")

    def fit(task):
        train, test = task
        return tree_model(model, **params).fit(train).transform(test) \
            .withColumnRenamed("prediction", "pred_target")

    # the fits are independent Spark jobs: submit them from a few driver
    # threads so small fits share the cluster instead of queueing
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks)) or 1) as pool:
        outs = list(pool.map(fit, tasks))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.drop("features", "_date")


def series_tree_backtest(df: DataFrame, keys: Sequence[str], model: str, t: str = "t", **params) -> DataFrame:
    """Trees per group (``keys``) and fold, all folds of a group grown
    together (``operators.trees``): the scored rows with ``k``,
    ``pred_target`` and the fold's ``importance`` per feature."""
    found = tr.fold_predictions(df, keys, tr.settings(model, TREE_PROFILES, **params), t=t).withColumnRenamed("t", t)
    rows = test_rows(df, t).filter(F.forall("x", lambda v: v.isNotNull()))
    return rows.join(found, list(dict.fromkeys([*keys, t, "k"])))


def backtest(df: DataFrame, keys: Sequence[str], model: str, alpha: float = 5.0,
             group_by: Sequence[str] = (), p: int | None = None, **params) -> DataFrame:
    """One model per group and fold; with ``pooled`` a tree model per fold
    date over all series (``tree_backtest``), its ``group_by`` apart."""
    if model == "ridge":
        return ridge_backtest(df, keys, alpha=alpha, p=p)
    if params.pop("pooled", False):
        return tree_backtest(df, keys, model, group_by=group_by, **params)
    return series_tree_backtest(df, keys, model, **params)


# ------------------------------------------------------------ de-levelled walk-forward (ML8)
def kind_rows(df: DataFrame, covariates: Sequence[str], kinds: Sequence[str],
              keys: Sequence[str] = ("series_id",), features: Sequence[str] | None = None) -> DataFrame:
    """One row per (series, period, target kind) with the kind's feature
    array ``x`` (raw), label ``y`` and ``eligible``. ``features`` names the
    columns of ``x``; by default they follow from the covariates.

    Features per kind: covariates, their 1-step changes, month dummies, and
    for ``yoy_logdiff`` also the 12-step changes (zeros for other kinds: a
    constant column has no effect on a standardised ridge or a tree).
    """
    keys = list(keys)
    dummies = [f"m_{k}" for k in range(2, 13)]
    base = list(covariates) + [f"{c}_chg1" for c in covariates] + dummies
    yoy_extra = [f"{c}_chg12" for c in covariates]
    d = df.withColumn("target_kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    is_yoy = F.col("target_kind") == "yoy_logdiff"
    x = F.array(*[F.col(c).cast("double") for c in base],
                *[F.when(is_yoy, F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in yoy_extra])
    if features is not None:
        x = F.array(*[F.col(c).cast("double") for c in features])
    y = (F.when(F.col("target_kind") == "mom_logdiff", F.col("mom_logdiff"))
         .when(F.col("target_kind") == "yoy_logdiff", F.col("yoy_logdiff"))
         .when(F.col("target_kind") == "trend_dev", F.col("trend_dev")))
    d = d.withColumns({"x": x, "y": y})
    return d.withColumn("eligible", F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))


def n_features(covariates: Sequence[str]) -> int:
    """Length of the ``x`` array built by ``kind_rows``."""
    return 3 * len(covariates) + 11


def fold_trend(keys: Sequence[str], t: str = "t", order: str = "period") -> Column:
    """Trend of ``log_y`` on ``t`` fitted on the *eligible* rows before this
    one (the fold's training slice), evaluated at this row's ``t``."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ly = F.when(F.col("eligible"), F.col("log_y"))
    return F.regr_intercept(ly, t).over(frame) + F.regr_slope(ly, t).over(frame) * F.col(t)


def walk_forward(dataset: DataFrame, covariates: Sequence[str], models: Sequence[str] = ("ridge",),
                 kinds: Sequence[str] = ("trend_dev", "mom_logdiff", "yoy_logdiff"), n_test: int = 24,
                 alpha: float = 5.0, keys: Sequence[str] = ("series_id",), **tree_params) -> DataFrame:
    """ML8/ML10: one-step walk-forward over the last ``n_test`` periods for
    every (target kind x model), refitting (and re-standardising) at every
    step, with levels reconstructed (ML11). ``dataset`` is the de-levelled
    table (FW6). Returns (keys, target_kind, model, period, actual,
    predicted, pred_target, error). A model that is unknown or cannot be
    fitted (tree fits run eagerly) is recorded as one row per series and kind
    with ``error``, without period and prediction; ``forecast_metrics`` keeps
    it through the ranking.
    """
    keys = list(keys)
    kk = keys + ["target_kind"]
    d = kind_rows(dataset, covariates, kinds, keys)
    d = d.withColumn("trend_next", fold_trend(kk))
    d = with_plan(d, plan_walk_forward, kk, n_test=n_test)
    # the panel is small next to the raw tables it came from: materialise it
    # once (reliable checkpoint) so the fit/score branches do not recompute it
    d = lin.materialize(d, kk)
    p = n_features(covariates)
    d = lin.spread(d, kk, p + 2)
    outs = []
    for m in models:
        try:
            scored = backtest(d, kk, m, alpha=alpha, group_by=["target_kind"], p=p, **tree_params)
            rec = reconstruct(scored, "target_kind", "pred_target", "trend_next")
            outs.append(rec.select(*kk, F.lit(m).alias("model"), "period",
                                   F.col("target").alias("actual"), "predicted", "pred_target",
                                   "error"))
        except (ValueError, PySparkException, Py4JJavaError) as ex:
            outs.append(d.select(*kk).distinct().select(
                *kk, F.lit(m).alias("model"), F.lit(str(ex)[:500]).alias("error")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


# ------------------------------------------------------------ nowcast (ML18)
def nowcast(dataset: DataFrame, covariates: Sequence[str], kind: str = "mom_logdiff",
            model: str = "ridge", alpha: float = 5.0, keys: Sequence[str] = ("series_id",),
            features: Sequence[str] | None = None, **tree_params) -> DataFrame:
    """ML18: refit on all history and predict the last row of each series,
    whose target is treated as unknown (its covariates are known: a nowcast).

    ``dataset`` must already contain that row (its features were computed
    by the same windows from the previous rows). ``features`` as in
    ``kind_rows``. Returns (keys, period, predicted, actual).
    """
    keys = list(keys)
    kk = keys + ["target_kind"]
    d = kind_rows(dataset, covariates, [kind], keys, features)
    d = d.withColumn("trend_next", fold_trend(kk))
    d = lin.materialize(with_plan(d, plan_walk_forward, kk, n_test=1), kk)
    p = n_features(covariates) if features is None else len(features)
    scored = backtest(d, kk, model, alpha=alpha, group_by=["target_kind"], p=p, **tree_params)
    rec = reconstruct(scored, "target_kind", "pred_target", "trend_next")
    return rec.select(*keys, "period", "predicted", F.col("target").alias("actual"))


def nowcast_next(panel: DataFrame, next_rows: DataFrame, covariates: Sequence[str],
                 kind: str = "mom_logdiff", model: str = "ridge", alpha: float = 5.0,
                 keys: Sequence[str] = ("series_id",), **tree_params) -> DataFrame:
    """ML18 for a month not yet in the data: ``next_rows`` holds
    (keys, period, covariates) of the coming month per series (inputs known
    in advance). They are appended with an unknown target, the de-levelled
    features of the new month are computed by the same windows from the
    months before it, the model is refitted on all history and the level is
    reconstructed. Returns (keys, period, predicted)."""
    from mensura.plans.flows import delevel_dataset
    future = next_rows.select(*keys, "period", *covariates).withColumn("target", F.lit(None).cast("double"))
    full = panel.select(*keys, "period", "target", *covariates).unionByName(future)
    ds = delevel_dataset(full, covariates, keys=keys)
    out = nowcast(ds, covariates, kind, model, alpha, keys, **tree_params)
    return out.join(future.select(*keys, "period"), [*keys, "period"], "left_semi").select(*keys, "period", "predicted")
