"""Catalog: level models with optional covariates (FW5 with WN6, ML13, ML16,
ML19, FW7) and nowcasts of one feature (ML18, FW9).

The candidates are ridges on one or two features, so block backtest, choice,
refit, hold-out metrics and effects have a closed form for the oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import backtest as bt
from mensura.operators import metrics as mt
from mensura.operators import selection as sel
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.flows import level_features
from mensura.plans.q_models import _WF1_SQL, dataset
from mensura.plans.registry import register
from mensura.plans.util import r, stored

COVS = panels.REV_COVARIATES
W = "PARTITION BY series_id ORDER BY period"
OPTIONAL = {"ridership": ("riders",)}
PAIR = ("target_lag1", "ridership_lag1")
CANDIDATES = {"base": ("ridge", PAIR[:1]), "extended": ("ridge", PAIR)}


def optional_panel(spark, sf):
    """The nation panel with a covariate that only nations before 'NATION_2' have,
    from July 1996 on (their order count)."""
    known = (F.col("series_id") < "NATION_2") & (F.col("period") >= F.lit("1996-07-01").cast("date"))
    return panels.rev_panel_dense(spark, sf).withColumn("riders", F.when(known, F.col("n_orders").cast("double")))


# usable rows: lags complete, and the covariate's too where the series has it
_ROWS = f"""
WITH v AS (SELECT series_id, period, target, CASE WHEN series_id < 'NATION_2' AND period >= DATE '1996-07-01'
             THEN CAST(n_orders AS DOUBLE) END AS riders FROM rev_panel_dense),
l AS (SELECT *, bool_or(riders IS NOT NULL) OVER (PARTITION BY series_id) AS has,
             lag(target, 1) OVER ({W}) AS x1, lag(target, 13) OVER ({W}) AS l13,
             lag(riders, 1) OVER ({W}) AS r1, lag(riders, 12) OVER ({W}) AS r12 FROM v),
u AS (SELECT series_id, period, target AS y, has, x1, r1, r12, CASE WHEN has THEN r1 ELSE 0.0 END AS x2 FROM l
      WHERE l13 <> 0 AND (NOT has OR (r1 IS NOT NULL AND r12 IS NOT NULL)))"""


@register("fw5_optional_covariates", with_views(_ROWS + """
SELECT series_id, period, y AS target, x1 AS target_lag1,
       CASE WHEN has THEN r1 ELSE 0.0 END AS ridership_lag1, CASE WHEN has THEN r12 ELSE 0.0 END AS ridership_lag12,
       round(CASE WHEN has THEN (r1 - r12) / (r12 + 1e-9) ELSE 0.0 END, 9) + 0.0 AS ridership_yoy,
       CASE WHEN has THEN '' ELSE 'ridership_lag1,ridership_lag12,ridership_yoy' END AS absent FROM u""",
                                                "rev_panel_dense"))
def fw5_optional(spark, sf):
    """Level features with the local block: nations without the covariate
    keep all their rows, those with it lose its warm-up."""
    d, _ = level_features(optional_panel(spark, sf), (), optional=OPTIONAL)
    return d.select("series_id", "period", "target", "target_lag1", "ridership_lag1", "ridership_lag12",
                    (F.round("ridership_yoy", 9) + F.lit(0.0)).alias("ridership_yoy"),
                    F.concat_ws(",", "absent").alias("absent"))


# one row per candidate and training slice, and the two-feature solve; a
# feature without spread has weight 0, which leaves the one-feature solve
_SOLVE = """
s AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n_all,
             row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS t FROM u),
c AS (SELECT s.series_id, s.period, s.y, s.x1, s.has, s.t, s.n_all - 12 AS n_fit, m.model,
             CASE WHEN m.model = 'base' THEN 0.0 ELSE s.x2 END AS x2
      FROM s CROSS JOIN (VALUES ('base'), ('extended')) AS m(model) WHERE n_all > 12),
pl AS (SELECT DISTINCT series_id, model, n_fit, CASE WHEN n_fit - 11 > 24 THEN 24 ELSE greatest(1, n_fit - 12) END AS c0,
              CASE WHEN n_fit - 11 > 24 THEN 6 ELSE 1 END AS step,
              CASE WHEN n_fit - 11 > 24 THEN CAST(ceil((n_fit - 35) / 6.0) AS INTEGER) ELSE 1 END AS k FROM c),
f AS (SELECT series_id, model, c0 + fold * step AS cutoff, least(c0 + fold * step + 12, n_fit) AS until
      FROM (SELECT *, unnest(range(0, k)) AS fold FROM pl)
      UNION ALL SELECT series_id, model, n_fit, NULL FROM pl),
g AS (SELECT f.series_id, f.model, f.cutoff, f.until, count(*) AS n, avg(c.x1) AS m1, avg(c.x2) AS m2, avg(c.y) AS my,
             stddev_pop(c.x1) AS s1, CASE WHEN stddev_pop(c.x2) > 0 THEN stddev_pop(c.x2) ELSE 1 END AS s2,
             covar_pop(c.x1, c.x2) AS c12, covar_pop(c.x1, c.y) AS c1y, covar_pop(c.x2, c.y) AS c2y
      FROM f JOIN c ON c.series_id = f.series_id AND c.model = f.model AND c.t < f.cutoff GROUP BY 1, 2, 3, 4),
w AS (SELECT *, n * c1y / s1 AS b1, n * c2y / s2 AS b2, n * c12 / s1 / s2 AS a12 FROM g),
z AS (SELECT *, ((n + 5.0) * (n + 5.0) - a12 * a12) AS det_two FROM w),
q AS (SELECT *, CASE WHEN c2y = 0 AND c12 = 0 THEN b1 / (n + 5.0) ELSE ((n + 5.0) * b1 - a12 * b2) / det_two END AS w1,
             CASE WHEN c2y = 0 AND c12 = 0 THEN 0 ELSE ((n + 5.0) * b2 - a12 * b1) / det_two END AS w2 FROM z),
h AS (SELECT *, my - w1 / s1 * m1 - w2 / s2 * m2 AS b0 FROM q),
bt AS (SELECT h.series_id, h.model, round(sqrt(sum((c.y - h.b0 - w1 / s1 * c.x1 - w2 / s2 * c.x2) ^ 2) / count(*)), 2) AS rmse
       FROM h JOIN c ON c.series_id = h.series_id AND c.model = h.model AND c.t >= h.cutoff AND c.t < h.until
       WHERE h.until IS NOT NULL GROUP BY 1, 2),
best AS (SELECT series_id, model AS best_model, rmse FROM bt
         QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) = 1),
pr AS (SELECT c.series_id, c.model, c.period, c.has, CASE WHEN c.t >= c.n_fit THEN 'test' ELSE 'train' END AS split, c.y,
              h.b0 + w1 / s1 * c.x1 + w2 / s2 * c.x2 AS prediction, w1, w2
       FROM h JOIN c ON c.series_id = h.series_id AND c.model = h.model WHERE h.until IS NULL)"""

_METRICS = """count(*) AS n,
       round(CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - prediction) ^ 2) / (var_pop(y) * count(*)) END, 6) AS R2,
       round(avg(abs(y - prediction)), 2) AS MAE, round(sqrt(sum((y - prediction) ^ 2) / count(*)), 2) AS RMSE,
       round(avg(CASE WHEN y <> 0 THEN abs(y - prediction) / abs(y) END) * 100, 6) AS MAPE_pct,
       round(avg(2 * abs(prediction - y) / (abs(y) + abs(prediction) + 1e-9)) * 100, 6) AS sMAPE_pct"""
_ROUNDED = [("R2", 6), ("MAE", 2), ("RMSE", 2), ("MAPE_pct", 6), ("sMAPE_pct", 6)]


def _selection(spark, sf):
    """Metrics, best, split metrics and predictions; an error counts to the
    cent, so equal candidates tie and the smaller name is taken."""
    parts = {}

    def scores(k):
        if not parts:
            parts["metrics"], parts["predictions"] = sel.candidate_scores(
                optional_panel(spark, sf), (), CANDIDATES, optional=OPTIONAL)
        return parts[k]

    metrics = stored(spark, sf, "optional_metrics", lambda: scores("metrics")).withColumn("RMSE", F.round("RMSE", 2))
    preds = stored(spark, sf, "optional_predictions", lambda: scores("predictions"))
    return metrics, *sel.choose(metrics, preds), preds


@register("ml13_optional_select", with_views(_ROWS + "," + _SOLVE + f"""
SELECT pr.series_id, best_model, split, {_METRICS} FROM pr
JOIN best ON pr.series_id = best.series_id AND pr.model = best.best_model GROUP BY 1, 2, 3""", "rev_panel_dense"))
def ml13_optional(spark, sf):
    """Per nation the better of a ridge without and one with the optional
    covariate, by block backtest; refit; train and hold-out metrics."""
    _, _, split_metrics, _ = _selection(spark, sf)
    return split_metrics.select("series_id", "best_model", "split", "n", *[r(c, k) for c, k in _ROUNDED])


@register("ml19_optional_summary", with_views(_ROWS + "," + _SOLVE + f"""
SELECT series_id, model, {_METRICS} FROM pr WHERE split = 'test' GROUP BY 1, 2""", "rev_panel_dense"))
def ml19_optional(spark, sf):
    """Hold-out metrics of both candidates."""
    preds = _selection(spark, sf)[-1].filter("split = 'test'")
    m = mt.forecast_metrics(preds, "y", "prediction", ["series_id", "model"], "A")
    return m.select("series_id", "model", "n", *[r(c, k) for c, k in _ROUNDED])


@register("fw7_optional_errors", with_views(_ROWS + "," + _SOLVE + """
SELECT pr.series_id, period, best_model, y, round(prediction, 2) AS prediction,
       round(abs(prediction - y) / y * 100, 6) AS abs_pct_error FROM pr
JOIN best ON pr.series_id = best.series_id AND pr.model = best.best_model WHERE split = 'test' AND y <> 0""",
                                             "rev_panel_dense"))
def fw7_optional(spark, sf):
    """Hold-out errors per month of the chosen candidate."""
    _, best, _, preds = _selection(spark, sf)
    chosen = preds.join(best, "series_id").filter("model = best_model AND split = 'test' AND y <> 0")
    return mt.period_errors(chosen, "y", "prediction").select(
        "series_id", "period", "best_model", "y", r("prediction", 2), r("abs_pct_error", 6))


@register("ml16_optional_effects", with_views(_ROWS + "," + _SOLVE + """,
e AS (SELECT DISTINCT series_id, model, has, w1, w2 FROM pr)
SELECT series_id, model, 'target_lag1' AS feature, round(w1, 2) + 0.0 AS importance FROM e
UNION ALL SELECT series_id, model, 'ridership_lag1', round(w2, 2) + 0.0 FROM e WHERE model = 'extended' AND has""",
                                               "rev_panel_dense"))
def ml16_optional(spark, sf):
    """Standardised coefficients of both candidates: only features that the
    candidate uses and the nation has."""
    _, _, _, preds = _selection(spark, sf)
    _, feats = level_features(optional_panel(spark, sf), (), optional=OPTIONAL)
    e = sel.effects_of(preds, feats)
    return e.withColumn("importance", F.round("importance", 2) + F.lit(0.0))


# ------------------------------------------------------------------ ML18, FW9
@register("ml18_nowcast_one_feature", with_views(
    _WF1_SQL.replace("n_all - 24", "n_all - 1").split("SELECT series_id, target_kind, count(*)")[0]
    .replace("SELECT series_id, target_kind, target AS actual", "SELECT series_id, period, target_kind, target AS actual")
    + "SELECT series_id, period, round(predicted, 2) AS predicted, actual FROM p WHERE target_kind = 'mom_logdiff'",
    "targets"))
def ml18_one(spark, sf):
    """Nowcast of each nation's last month by a ridge of the MoM log change
    on the change of the order count."""
    d = bt.nowcast(dataset(spark, sf), COVS, "mom_logdiff", "ridge", features=["n_orders_chg1"])
    return d.select("series_id", "period", r("predicted", 2), "actual")


@register("fw9_nowcast_one_feature", with_views(f"""
WITH b AS (SELECT series_id, period, log_y, yoy_logdiff AS y,
                  CAST(n_orders - lag(n_orders, 12) OVER ({W}) AS DOUBLE) AS x FROM targets),
m AS (SELECT series_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS cxy, var_pop(x) AS vx
      FROM b WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
z AS (SELECT series_id, max(period) AS last, max_by(n_orders, period) AS coming FROM targets GROUP BY 1)
SELECT z.series_id, CAST(z.last + INTERVAL 1 MONTH AS DATE) AS period,
       round(exp(a.log_y + my + n * cxy / ((n + 5.0) * vx) * (z.coming - a.n_orders - mx)), 2) AS predicted
FROM z JOIN m ON m.series_id = z.series_id
JOIN targets a ON a.series_id = z.series_id AND a.period = CAST(z.last - INTERVAL 11 MONTH AS DATE)""", "targets"))
def fw9_one(spark, sf):
    """Nowcast flow for the month after each nation's last: YoY log change
    by a ridge on the 12-month change of the order count, level from the same
    month a year before; the coming count is the last month's."""
    panel = panels.rev_panel_dense(spark, sf)
    last = panel.groupBy("series_id").agg(F.max_by(F.struct(*COVS), "period").alias("c"),
                                          F.add_months(F.max("period"), 1).alias("period"))
    d = bt.nowcast_next(panel, last.select("series_id", "period", "c.*"), COVS, "yoy_logdiff", "ridge",
                        features=["n_orders_chg12"])
    return d.select("series_id", "period", r("predicted", 2))
