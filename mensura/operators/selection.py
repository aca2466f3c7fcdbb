"""Model selection on level features (ML7 driver, ML13, ML16, ML19).

Candidates are scored by a rolling-origin block backtest on the training
part of every series, the best one per series is picked by RMSE, refitted on
the whole training part and scored on train and hold-out. All models are
fitted per series: ridge by Gram aggregation and solve, trees by
``operators.trees``. What a refitted model makes of its features (ML16) is
kept beside its predictions.

A candidate is a model on all features, or a model on some of them: a
mapping ``name -> (model, feature names)`` lets the same ridge compete with
and without the local covariates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators import backtest as bt
from mensura.operators import linear as lin
from mensura.operators import trees as tr
from mensura.operators.metrics import forecast_metrics, select_best
from mensura.operators.windows import add_time_index, time_split
from mensura.plans.flows import level_features


def level_dataset(panel: DataFrame, covariates: Sequence[str], test_months: int = 12,
                  keys: Sequence[str] = ("series_id",),
                  optional: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """FW5 + SO5: level features (``optional`` as there), ``split`` (last
    ``test_months`` = test), time index ``t`` over usable rows, raw feature
    array ``x``, ``y``."""
    d, feats = level_features(panel, covariates, keys=keys, optional=optional)
    d = time_split(d, test_months, keys)
    d = add_time_index(d, keys)
    d = d.withColumns({"x": F.array(*[F.col(c).cast("double") for c in feats]), "y": F.col("target"),
                       "eligible": F.lit(True)})
    return d, feats


def block_backtest(train: DataFrame, model: str, keys: Sequence[str] = ("series_id",),
                   horizon: int = 12, min_train: int = 24, step: int = 6, alpha: float = 5.0,
                   **tree_params) -> DataFrame:
    """ML7: rolling-origin block backtest on the given (training) rows;
    predictions of all blocks pooled. Returns scored rows with ``k``."""
    planned = bt.with_plan(train, bt.plan_blocks, keys, horizon=horizon, min_train=min_train, step=step)
    return bt.backtest(planned, keys, model, alpha=alpha, **tree_params)


def refit_predict(data: DataFrame, model: str, keys: Sequence[str] = ("series_id",),
                  alpha: float = 5.0, p: int | None = None, **tree_params) -> DataFrame:
    """Fit on ``split = 'train'`` rows, predict every row (``prediction``);
    ``importance``: standardised coefficients of a ridge, shares of the gain
    of a tree model, in the order of the features."""
    keys = list(keys)
    if model == "ridge":
        data = lin.center(data, p or int(data.select(F.max(F.size("x"))).first()[0]), keys)
        coef = lin.fit_ridge(data.filter(F.col("split") == "train"), keys=keys, alpha=alpha, p=p)
        j = data.join(coef, keys)
        return j.withColumns({"prediction": lin.predict_linear(j), "importance": F.slice("coef", F.col("p") + 2, F.col("p"))}
                             ).drop("coef", "p")
    found = tr.split_predictions(data, keys, tr.settings(model, bt.TREE_PROFILES, **tree_params))
    return data.join(found, [*keys, "t"])


Candidates = Sequence[str] | Mapping[str, tuple[str, Sequence[str] | None]]


def auto_select(panel: DataFrame, covariates: Sequence[str], candidates: Candidates = ("ridge",),
                test_months: int = 12, keys: Sequence[str] = ("series_id",), **kw):
    """ML13: backtest candidates (ML7) -> best per series by RMSE (AG12) ->
    refit on train -> metrics on train and hold-out (AG9 by split).

    Returns ``(backtest_metrics, best, split_metrics, predictions)``.
    """
    metrics, allp = candidate_scores(panel, covariates, candidates, test_months, keys, **kw)
    return metrics, *choose(metrics, allp, keys), allp


def candidate_scores(panel: DataFrame, covariates: Sequence[str], candidates: Candidates = ("ridge",),
                     test_months: int = 12, keys: Sequence[str] = ("series_id",),
                     optional: Mapping[str, Sequence[str]] | None = None, **kw):
    """Block backtest metrics (keys, model, ...) and, refitted on the training
    rows, predictions of all rows (keys, period, split, y, prediction,
    importance, model) of every candidate. The importance of a feature that a
    candidate does not use is null; with ``optional`` the column ``absent``
    comes along."""
    keys = list(keys)
    data, feats = level_dataset(panel, covariates, test_months, keys, optional)
    if not isinstance(candidates, Mapping):
        candidates = {m: (m, None) for m in candidates}
    carried = ["absent"] if "absent" in data.columns else []
    # every candidate re-reads the same rows: materialise them once
    data = lin.materialize(data.filter(F.col("split") != "error"), keys)
    bm, preds = [], []
    for name, (m, used) in candidates.items():
        at = [feats.index(f) for f in (feats if used is None else used)]
        mine = data if used is None else data.withColumn("x", F.array(*[F.col("x")[i] for i in at]))
        scored = block_backtest(mine.filter(F.col("split") == "train"), m, keys, p=len(at), **kw)
        bm.append(forecast_metrics(scored.withColumn("model", F.lit(name)), "y", "pred_target",
                                   keys + ["model"], "A"))
        fitted = refit_predict(mine, m, keys, p=len(at), **{k: v for k, v in kw.items()
                                                            if k not in ("horizon", "min_train", "step")})
        if used is not None:
            fitted = fitted.withColumn("importance", F.array(*[
                F.col("importance")[at.index(i)] if i in at else F.lit(None).cast("double")
                for i in range(len(feats))]))
        preds.append(fitted.select(*keys, "period", "split", "y", "prediction", "importance", *carried)
                     .withColumn("model", F.lit(name)))
    metrics = bm[0]
    for b in bm[1:]:
        metrics = metrics.unionByName(b)
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    return metrics, allp


def choose(metrics: DataFrame, allp: DataFrame, keys: Sequence[str] = ("series_id",)):
    """The best candidate per series by RMSE, and its metrics by split."""
    keys = list(keys)
    best = select_best(metrics, "RMSE", "model", keys, "min").select(*keys, F.col("model").alias("best_model"))
    chosen = allp.join(best, keys).filter(F.col("model") == F.col("best_model"))
    return best, forecast_metrics(chosen, "y", "prediction", keys + ["best_model", "split"], "A")


def feature_effects(data: DataFrame, feats: Sequence[str], model: str = "ridge",
                    keys: Sequence[str] = ("series_id",), alpha: float = 5.0, **tree_params) -> DataFrame:
    """ML16: per series the standardised ridge coefficients, or the shares
    of the gain of its tree model, as (keys, model, feature, importance)."""
    preds = refit_predict(data, model, keys, alpha, len(feats), **tree_params).withColumn("model", F.lit(model))
    return effects_of(preds, feats, keys)


def effects_of(preds: DataFrame, feats: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, model, feature, importance) of models whose predictions
    (``refit_predict``, ``candidate_scores``) are at hand: no second fit.
    Features that a model does not use, or a series does not have
    (``absent``), give no row."""
    absent = F.first("absent") if "absent" in preds.columns else F.array().cast("array<string>")
    models = preds.groupBy(*keys, "model").agg(F.first("importance").alias("importance"), absent.alias("_absent"))
    names = F.array(*[F.lit(f) for f in feats])
    z = models.select(*keys, "model", "_absent", F.arrays_zip(names.alias("feature"), F.col("importance")).alias("z"))
    z = z.select(*keys, "model", "_absent", F.inline("z"))
    return z.filter(F.col("importance").isNotNull() & ~F.array_contains("_absent", F.col("feature"))).drop("_absent")


def chosen_effects(preds: DataFrame, feats: Sequence[str], best: DataFrame,
                   keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """ML16 for the selected models: ``best`` has (keys, best_model),
    ``preds`` the candidates' predictions."""
    keys = list(keys)
    chosen = preds.join(best, keys).filter(F.col("model") == F.col("best_model"))
    return effects_of(chosen, feats, keys)
