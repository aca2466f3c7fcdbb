"""Catalog: regression, backtests and selection (ML1-ML19, SO6).

Model fits have no SQL oracle (rows/property checks; Ridge and HAC are
checked against published numbers in tests/test_golden.py). Where the
operator is linear algebra with a closed form (one-feature ridge, fold
layouts, standardisation, reconstruction from given predictions) an oracle
is given.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mensura.operators import backtest as bt
from mensura.operators import linear as lin
from mensura.operators import metrics as mt
from mensura.operators import selection as sel
from mensura.operators.reconstruct import reconstruct
from mensura.operators.sort import rank_features
from mensura.operators.windows import add_time_index, time_split
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.flows import delevel_dataset
from mensura.plans.registry import register
from mensura.plans.util import r, stored

COVS = panels.REV_COVARIATES
W = "PARTITION BY series_id ORDER BY period"
# all per series; the last, with column sampling and leaf penalty, is the
# optional fourth candidate
CANDIDATES = ("ridge", "forest", "boosting", "boosting_colsample")


def dataset(spark, sf):
    """FW6 on the dense nation panel."""
    return delevel_dataset(panels.rev_panel_dense(spark, sf), COVS)


# ------------------------------------------------------------------ ML1
@register("ml1_standardize", with_views("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rn FROM rev_panel_dense),
st AS (SELECT series_id, """ + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in COVS) + """ FROM s WHERE rn > 12 GROUP BY 1)
SELECT s.series_id, s.period, """ + ", ".join(
    f"round(({c} - mu_{c}) / CASE WHEN sd_{c} IS NULL OR sd_{c} <= 1e-12 * greatest(1.0, abs(mu_{c})) "
    f"THEN 1.0 ELSE sd_{c} END, 8) + 0.0 AS {c}" for c in COVS)
    + " FROM s JOIN st ON s.series_id = st.series_id", "rev_panel_dense"))
def ml1(spark, sf):
    """Scale every row with the mean / population sigma of the series'
    training rows (all but the last 12)."""
    d = time_split(panels.rev_panel_dense(spark, sf), 12, check=False).select("series_id", "period", "split", *COVS)
    z = lin.standardize(d.filter(F.col("split") == "train"), d, COVS)
    return z.select("series_id", "period", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in COVS])


@register("ml1_fold_scaler", with_views(f"""
SELECT series_id, period, """ + ", ".join(
    f"round(avg({c}) OVER wf, 6) AS {c}_mu, "
    f"round(CASE WHEN stddev_pop({c}) OVER wf <= 1e-12 * greatest(1.0, abs(avg({c}) OVER wf)) THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER wf END, 6) AS {c}_sd" for c in COVS) + f"""
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rn FROM rev_panel_dense)
WINDOW wf AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY rn <= 24""", "rev_panel_dense"))
def ml1_folds(spark, sf):
    """Scaler statistics (mean, population sigma) of every covariate for
    each of the 24 walk-forward folds: the expanding window up to each fold
    cutoff."""
    from pyspark.sql import Window as Wd
    d = lin.fold_scaler_stats(panels.rev_panel_dense(spark, sf), COVS)
    d = d.withColumn("_rn", F.row_number().over(Wd.partitionBy("series_id").orderBy(F.col("period").desc())))
    return d.filter(F.col("_rn") <= 24).select(
        "series_id", "period", *[r(f"{c}_{s_}", 6) for c in COVS for s_ in ("mu", "sd")])


# ------------------------------------------------------------------ ML2
@register("ml2_ridge_one_feature", with_views("""
WITH d AS (SELECT series_id, mom_logdiff AS y, CAST(n_orders_chg1 AS DOUBLE) AS x FROM (
             SELECT *, n_orders - lag(n_orders, 1) OVER (PARTITION BY series_id ORDER BY period) AS n_orders_chg1
             FROM targets) WHERE mom_logdiff IS NOT NULL AND n_orders_chg1 IS NOT NULL),
m AS (SELECT series_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx
      FROM d GROUP BY 1)
SELECT series_id, round(my - (n * cxy / ((n + 5.0) * vx)) * mx, 8) AS intercept,
       round(n * cxy / ((n + 5.0) * vx), 10) AS slope FROM m""", "targets"))
def ml2_one(spark, sf):
    """Ridge (alpha 5, standardised feature, free intercept) of the MoM log
    change on the 1-step change of order count, per nation; closed form in
    the oracle."""
    d = dataset(spark, sf).withColumns({"x": F.array(F.col("n_orders_chg1").cast("double")),
                                        "y": F.col("mom_logdiff")})
    coef = lin.fit_ridge(d, alpha=5.0)
    # coefficients are for the raw x here (no centring), so b0 is the intercept
    return coef.select("series_id", F.round(F.col("coef")[0], 8).alias("intercept"),
                       F.round(F.col("coef")[1], 10).alias("slope"))


@register("ml2_ridge_two_features", with_views(f"""
WITH d AS (SELECT series_id, mom_logdiff AS y,
                  CAST(n_orders - lag(n_orders, 1) OVER ({W}) AS DOUBLE) AS x1,
                  avg_disc - lag(avg_disc, 1) OVER ({W}) AS x2 FROM targets),
e AS (SELECT * FROM d WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (SELECT series_id, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
             stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r12,
             covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y FROM e GROUP BY 1),
w AS (SELECT *, n * c1y / s1 AS b1, n * c2y / s2 AS b2,
             (n + 5.0) * (n + 5.0) - (n * r12) * (n * r12) AS det FROM m),
z AS (SELECT *, ((n + 5.0) * b1 - n * r12 * b2) / det / s1 AS beta1,
                ((n + 5.0) * b2 - n * r12 * b1) / det / s2 AS beta2 FROM w)
SELECT series_id, round(my - beta1 * m1 - beta2 * m2, 8) + 0.0 AS intercept,
       round(beta1, 8) + 0.0 AS beta_n_orders_chg1, round(beta2, 6) + 0.0 AS beta_avg_disc_chg1 FROM z""",
                                                "targets"))
def ml2_two(spark, sf):
    """Ridge (alpha 5, standardised, free intercept) of the MoM log change on
    two regressors per nation; with two features the solve is a closed-form
    2x2 system in the oracle, so the off-diagonal Gram terms are checked."""
    d = dataset(spark, sf).withColumns({
        "x": F.array(F.col("n_orders_chg1").cast("double"), F.col("avg_disc_chg1").cast("double")),
        "y": F.col("mom_logdiff")})
    coef = lin.fit_ridge(d, alpha=5.0, p=2)
    return coef.select("series_id", (F.round(F.col("coef")[0], 8) + F.lit(0.0)).alias("intercept"),
                       (F.round(F.col("coef")[1], 8) + F.lit(0.0)).alias("beta_n_orders_chg1"),
                       (F.round(F.col("coef")[2], 6) + F.lit(0.0)).alias("beta_avg_disc_chg1"))


@register("ml2_ridge")
def ml2(spark, sf):
    """Ridge per nation on the full MoM feature set; (series, feature,
    standardised coefficient)."""
    d = bt.kind_rows(dataset(spark, sf), COVS, ["mom_logdiff"]).filter(F.col("eligible"))
    coef = lin.fit_ridge(d, alpha=5.0)
    names = [*COVS, *[f"{c}_chg1" for c in COVS], *[f"m_{k}" for k in range(2, 13)],
             *[f"{c}_chg12" for c in COVS]]
    z = coef.select("series_id", F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"),
                                              F.slice("coef", F.col("p") + 2, F.col("p")).alias("coef"))
                    .alias("z"))
    return z.select("series_id", F.inline("z"))


@register("ml2_ridge_pooled")
def ml2_pooled(spark, sf):
    """One ridge pooled over all nations (MoM log change on the MoM feature
    set, features centred per nation) with pyspark.ml LinearRegression;
    (feature, coefficient)."""
    d = bt.kind_rows(dataset(spark, sf), COVS, ["mom_logdiff"]).filter(F.col("eligible"))
    b0, beta = lin.fit_ridge_pooled(d, alpha=5.0)
    names = [*COVS, *[f"{c}_chg1" for c in COVS], *[f"m_{k}" for k in range(2, 13)],
             *[f"{c}_chg12" for c in COVS]]
    rows = [("(intercept)", b0)] + [(n, float(v)) for n, v in zip(names, beta)]
    return spark.createDataFrame(rows, "feature string, coef double")


# ------------------------------------------------------------------ ML3-ML5, ML8, ML10
def walk_forward_predictions(spark, sf, models, profile="delevel"):
    """Walk-forward predictions over 24 fold dates and three target kinds.
    The fits of a model at the published settings take minutes, so the
    queries of one application share them, and all models one dataset: its
    panel is the part that grows with the tables."""
    def rows():
        return stored(spark, sf, "walk_forward_dataset", lambda: dataset(spark, sf))

    out = None
    for m in models:
        p = stored(spark, sf, f"walk_forward_{profile}_{m}",
                   lambda m=m: bt.walk_forward(rows(), COVS, [m], n_test=24, profile=profile))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def _wf_metrics(spark, sf, models, profile="delevel"):
    return mt.forecast_metrics(walk_forward_predictions(spark, sf, models, profile),
                               keys=["series_id", "target_kind", "model"], which="B")


def auto_selection(spark, sf):
    """Block backtest metrics and predictions of all candidates on the nation
    panel, shared like ``walk_forward_predictions``; then best and split
    metrics as ``selection.auto_select`` gives them."""
    parts = {}

    def scores(k):
        if not parts:
            parts["metrics"], parts["predictions"] = sel.candidate_scores(
                panels.rev_panel_dense(spark, sf), COVS, CANDIDATES, profile="level")
        return parts[k]

    metrics = stored(spark, sf, "candidate_metrics", lambda: scores("metrics"))
    preds = stored(spark, sf, "candidate_predictions", lambda: scores("predictions"))
    return metrics, *sel.choose(metrics, preds), preds


@register("ml8_walk_forward")
def ml8(spark, sf):
    """Ridge walk-forward, last 24 months, all three target kinds, levels
    reconstructed, metrics per (nation, kind)."""
    return _wf_metrics(spark, sf, ["ridge"])


_WF1_SQL = f"""
WITH b AS (SELECT *, CAST(n_orders - lag(n_orders, 1) OVER ({W}) AS DOUBLE) AS x FROM targets),
k AS (SELECT b.*, kk.target_kind,
             CASE kk.target_kind WHEN 'mom_logdiff' THEN mom_logdiff WHEN 'yoy_logdiff' THEN yoy_logdiff
                  ELSE trend_dev END AS y
      FROM b CROSS JOIN (VALUES ('mom_logdiff'), ('yoy_logdiff'), ('trend_dev')) AS kk(target_kind)),
e AS (SELECT *, y IS NOT NULL AND x IS NOT NULL AS ok,
             count(*) OVER (PARTITION BY series_id, target_kind) AS n_all FROM k),
f AS (SELECT *,
        count(CASE WHEN ok THEN 1 END) OVER wp AS n,
        avg(CASE WHEN ok THEN x END) OVER wp AS mx, avg(CASE WHEN ok THEN y END) OVER wp AS my,
        covar_pop(CASE WHEN ok THEN y END, CASE WHEN ok THEN x END) OVER wp AS cxy,
        var_pop(CASE WHEN ok THEN x END) OVER wp AS vx,
        regr_intercept(CASE WHEN ok THEN log_y END, t) OVER wp
          + regr_slope(CASE WHEN ok THEN log_y END, t) OVER wp * t AS trend_next
      FROM e WINDOW wp AS (PARTITION BY series_id, target_kind ORDER BY period
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT series_id, target_kind, target AS actual,
             exp(CASE target_kind WHEN 'mom_logdiff' THEN log_lag1 WHEN 'yoy_logdiff' THEN log_lag12
                 ELSE trend_next END
                 + (my - (n * cxy / ((n + 5.0) * vx)) * mx) + (n * cxy / ((n + 5.0) * vx)) * x) AS predicted
      FROM f WHERE t >= n_all - 24 AND n > 0 AND x IS NOT NULL)
SELECT series_id, target_kind, count(*) AS n,
       round(CASE WHEN var_pop(actual) > 0
             THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END, 6) AS R2,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100, 6) AS MAPE_pct,
       round(sqrt(sum((actual - predicted) ^ 2) / count(*)), 2) AS RMSE
FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2"""


@register("ml8_walk_forward_one_feature", with_views(_WF1_SQL, "targets"))
def ml8_one(spark, sf):
    """Walk-forward ridge (24 one-step folds, three target kinds, levels
    reconstructed) with a single feature, the 1-step change of the order
    count. It runs the same fold plan, bucket Grams, prefix solve, scoring
    and reconstruction as the full grid; with one feature the fold models
    have a closed form, so the oracle recomputes them with expanding SQL
    window aggregates."""
    kk = ["series_id", "target_kind"]
    return _one_feature_metrics(bt.ridge_backtest(_one_feature(spark, sf), kk, p=1))


def _one_feature(spark, sf):
    """The walk-forward plan over the 1-step change of the order count."""
    kk = ["series_id", "target_kind"]
    d = dataset(spark, sf).withColumn("target_kind", F.explode(F.array(*[F.lit(k) for k in
                                                                         ("mom_logdiff", "yoy_logdiff", "trend_dev")])))
    y = (F.when(F.col("target_kind") == "mom_logdiff", F.col("mom_logdiff"))
         .when(F.col("target_kind") == "yoy_logdiff", F.col("yoy_logdiff")).otherwise(F.col("trend_dev")))
    d = d.withColumns({"x": F.array(F.col("n_orders_chg1").cast("double")), "y": y})
    d = d.withColumn("eligible", F.col("y").isNotNull() & F.col("x")[0].isNotNull())
    d = d.withColumn("trend_next", bt.fold_trend(kk))
    return lin.materialize(bt.with_plan(d, bt.plan_walk_forward, kk, n_test=24), kk)


def _one_feature_metrics(scored):
    kk = ["series_id", "target_kind"]
    rec = reconstruct(scored).select(*kk, F.col("target").alias("actual"), "predicted")
    m = mt.forecast_metrics(rec, keys=kk, which="B")
    return m.select(*kk, "n", r("R2", 6), r("MAPE_pct", 6), r("RMSE", 2))


def _one_split_sql(rate: float, penalty: float, min_leaf: int) -> str:
    """One tree of one split per fold: the best cut from running sums over
    the fold's training rows in order of ``x``, the lowest of equal ones."""
    side = f"CASE WHEN f.x <= c.cut THEN c.s_le / (c.n_le + {penalty}) ELSE (c.s - c.s_le) / (c.n - c.n_le + {penalty}) END"
    return f"""
WITH b AS (SELECT *, CAST(n_orders - lag(n_orders, 1) OVER ({W}) AS DOUBLE) AS x FROM targets),
k AS (SELECT b.*, kk.target_kind,
             CASE kk.target_kind WHEN 'mom_logdiff' THEN mom_logdiff WHEN 'yoy_logdiff' THEN yoy_logdiff
                  ELSE trend_dev END AS y
      FROM b CROSS JOIN (VALUES ('mom_logdiff'), ('yoy_logdiff'), ('trend_dev')) AS kk(target_kind)),
e AS (SELECT *, y IS NOT NULL AND x IS NOT NULL AS ok,
             count(*) OVER (PARTITION BY series_id, target_kind) AS n_all FROM k),
f AS (SELECT *, regr_intercept(CASE WHEN ok THEN log_y END, t) OVER wp
          + regr_slope(CASE WHEN ok THEN log_y END, t) OVER wp * t AS trend_next
      FROM e WINDOW wp AS (PARTITION BY series_id, target_kind ORDER BY period
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT f.series_id, f.target_kind, f.t, j.x, j.y - avg(j.y) OVER w AS r, avg(j.y) OVER w AS mean, count(*) OVER w AS n
      FROM f JOIN e j ON f.series_id = j.series_id AND f.target_kind = j.target_kind AND j.t < f.t AND j.ok
      WHERE f.t >= f.n_all - 24 WINDOW w AS (PARTITION BY f.series_id, f.target_kind, f.t)),
g AS (SELECT *, count(*) OVER o AS n_le, sum(r) OVER o AS s_le, sum(r) OVER w AS s, sum(r * r) OVER w * 1e-12 AS noise,
             min(x) OVER (o GROUPS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS x_next
      FROM m WINDOW w AS (PARTITION BY series_id, target_kind, t), o AS (PARTITION BY series_id, target_kind, t ORDER BY x)),
h AS (SELECT *, CASE WHEN n_le >= {min_leaf} AND n - n_le >= {min_leaf} THEN s_le * s_le / (n_le + {penalty})
             + (s - s_le) * (s - s_le) / (n - n_le + {penalty}) - s * s / (n + {penalty}) END AS gain FROM g),
i AS (SELECT *, max(gain) OVER (PARTITION BY series_id, target_kind, t) AS best FROM h),
c AS (SELECT series_id, target_kind, t, any_value(mean) AS mean, any_value(n) AS n, any_value(s) AS s,
             min((x + x_next) / 2) FILTER (WHERE best > noise AND gain >= best - noise) AS cut,
             arg_min(n_le, x) FILTER (WHERE best > noise AND gain >= best - noise) AS n_le,
             arg_min(s_le, x) FILTER (WHERE best > noise AND gain >= best - noise) AS s_le
      FROM i GROUP BY 1, 2, 3),
p AS (SELECT f.series_id, f.target_kind, f.target AS actual,
             exp(CASE f.target_kind WHEN 'mom_logdiff' THEN log_lag1 WHEN 'yoy_logdiff' THEN log_lag12
                 ELSE trend_next END + c.mean + {rate} * CASE WHEN c.cut IS NULL THEN c.s / (c.n + {penalty}) ELSE {side} END
             ) AS predicted
      FROM f JOIN c ON f.series_id = c.series_id AND f.target_kind = c.target_kind AND f.t = c.t WHERE f.x IS NOT NULL)
SELECT series_id, target_kind, count(*) AS n,
       round(CASE WHEN var_pop(actual) > 0
             THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END, 6) AS R2,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100, 6) AS MAPE_pct,
       round(sqrt(sum((actual - predicted) ^ 2) / count(*)), 2) AS RMSE
FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2"""


@register("ml3_forest_one_split", with_views(_one_split_sql(1.0, 0.0, 3), "targets"))
def ml3_one(spark, sf):
    """The walk-forward forest of ML3 cut to one unsampled tree of one split
    on one feature, which SQL can recompute per fold."""
    return _one_feature_metrics(bt.series_tree_backtest(
        _one_feature(spark, sf), ["series_id", "target_kind"], "forest", num_trees=1, max_depth=1, bootstrap=False))


@register("ml4_boosting_one_round", with_views(_one_split_sql(0.05, 0.0, 1), "targets"))
def ml4_one(spark, sf):
    """The walk-forward boosting of ML4 after one round of one split on one feature."""
    return _one_feature_metrics(bt.series_tree_backtest(
        _one_feature(spark, sf), ["series_id", "target_kind"], "boosting", num_trees=1, max_depth=1))


@register("ml5_boosting_one_round", with_views(_one_split_sql(0.03, 2.0, 1), "targets"))
def ml5_one(spark, sf):
    """The penalised boosting of ML5 after one round of one split on one
    feature: gains and leaf values with the leaf penalty 2."""
    return _one_feature_metrics(bt.series_tree_backtest(
        _one_feature(spark, sf), ["series_id", "target_kind"], "boosting_colsample", profile="level", num_trees=1,
        max_depth=1, subsample=1.0, feature_subset="all"))


@register("ml8_walk_forward_suppliers")
def ml8_supp(spark, sf):
    """The same ridge walk-forward grid over the supplier panel: one series
    per supplier (1,000 at sf 0.1), 3 kinds x 24 one-step folds each, all in
    one Spark job."""
    ds = delevel_dataset(panels.supplier_panel_dense(spark, sf), panels.SUPP_COVARIATES)
    preds = bt.walk_forward(ds, panels.SUPP_COVARIATES, ["ridge"], n_test=24)
    return mt.forecast_metrics(preds, keys=["series_id", "target_kind", "model"], which="B")


@register("ml3_forest")
def ml3(spark, sf):
    """Forest per nation at the published settings, 24 fold dates, three kinds."""
    return _wf_metrics(spark, sf, ["forest"])


@register("ml4_boosting")
def ml4(spark, sf):
    """Boosting per nation at the published settings, 24 fold dates, three kinds."""
    return _wf_metrics(spark, sf, ["boosting"])


@register("ml5_boosting_colsample")
def ml5(spark, sf):
    """Boosting with column sampling and leaf penalty per nation at the
    published settings, 24 fold dates, three kinds."""
    return _wf_metrics(spark, sf, ["boosting_colsample"], "level")


@register("ml10_grid")
def ml10(spark, sf):
    """Target kind x model grid over 24 fold dates with ranking (SO4) and
    thresholds (SC13); a failing combo keeps its ``error``."""
    return _grid(spark, sf, ["ridge", "forest", "boosting"])


def _grid(spark, sf, models):
    m = _wf_metrics(spark, sf, models)
    m = m.withColumn("combo", F.concat_ws(" | ", "target_kind", "model"))
    return mt.threshold_check(mt.rank_combos(m, "MAPE_pct", "combo"))


@register("ml10_grid_failing_model", with_views("""
SELECT series_id, k.target_kind, m.model, CAST(CASE WHEN m.model = 'ridge' THEN least(24, count(*) - 13) ELSE 0 END AS BIGINT) AS n,
       CASE WHEN m.model = 'ridge' THEN NULL ELSE 'unknown tree model nosuch' END AS error
FROM targets CROSS JOIN (VALUES ('mom_logdiff'), ('yoy_logdiff'), ('trend_dev')) AS k(target_kind)
CROSS JOIN (VALUES ('ridge'), ('nosuch')) AS m(model) GROUP BY 1, 2, 3""", "targets"))
def ml10_failing(spark, sf):
    """The grid with a model that does not exist: its combos stay, with their
    error and nothing scored, behind those that ran."""
    return _grid(spark, sf, ["ridge", "nosuch"]).select("series_id", "target_kind", "model", "n", "error")


# ------------------------------------------------------------------ fold layouts
def _indexed(spark, sf):
    return add_time_index(panels.rev_panel_dense(spark, sf)).select("series_id", "period", "t")


_LAYOUT_SQL = """
WITH d AS (SELECT series_id, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS t FROM rev_panel_dense),
n AS (SELECT series_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT series_id, {c0} AS c0, {step} AS step, {K} AS K, {h} AS h FROM n),
f AS (SELECT series_id, c0, step, h, unnest(range(0, K)) AS k FROM p),
c AS (SELECT series_id, k, c0 + k * step AS cutoff, h FROM f)
SELECT c.series_id, CAST(c.k AS INTEGER) AS k, CAST(c.cutoff AS INTEGER) AS cutoff, count(*) AS n_train,
       CAST(c.cutoff AS INTEGER) AS test_first_t, CAST(c.cutoff + c.h - 1 AS INTEGER) AS test_last_t
FROM c JOIN d ON c.series_id = d.series_id AND d.t < c.cutoff GROUP BY 1, 2, 3, 5, 6"""

_BLOCK = dict(
    c0="CASE WHEN greatest(0, ceil((n - 12 + 1 - 24) / 6.0)) > 0 THEN 24 ELSE greatest(1, n - 12) END",
    step="CASE WHEN greatest(0, ceil((n - 12 + 1 - 24) / 6.0)) > 0 THEN 6 ELSE 1 END",
    K="CASE WHEN greatest(0, ceil((n - 12 + 1 - 24) / 6.0)) > 0 THEN CAST(ceil((n - 12 + 1 - 24) / 6.0) AS BIGINT) ELSE 1 END",
    h="12")
_KFOLD = dict(c0="n - least(4, n - 1) * (n // (least(4, n - 1) + 1))", step="n // (least(4, n - 1) + 1)",
              K="least(4, n - 1)", h="n // (least(4, n - 1) + 1)")


def _layout(spark, sf, plan, **kw):
    d = bt.with_plan(_indexed(spark, sf), plan, ["series_id"], **kw)
    lay = bt.fold_layout(d, ["series_id"])
    return lay.select("series_id", F.col("k").cast("int").alias("k"), F.col("cutoff").cast("int").alias("cutoff"),
                      "n_train", F.col("test_first_t").cast("int").alias("test_first_t"),
                      F.col("test_last_t").cast("int").alias("test_last_t"))


@register("ml7_block_layout", with_views(_LAYOUT_SQL.format(W=W, **_BLOCK), "rev_panel_dense"))
def ml7_layout(spark, sf):
    """Rolling-origin cutoffs range(24, n - 12 + 1, 6), 12-month blocks."""
    return _layout(spark, sf, bt.plan_blocks, horizon=12, min_train=24, step=6)


@register("ml9_kfold_layout", with_views(_LAYOUT_SQL.format(W=W, **_KFOLD), "rev_panel_dense"))
def ml9_layout(spark, sf):
    """Time-series 4-fold split: k+1 equal blocks, remainder to the first
    training block."""
    return _layout(spark, sf, bt.plan_kfold, n_splits=4)


_FOLD1_SQL = """
WITH d AS (SELECT series_id, period, target AS y, lag(target, 1) OVER ({W}) AS x,
                  CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS t FROM rev_panel_dense),
n AS (SELECT series_id, count(*) AS n FROM d GROUP BY 1),
pl AS (SELECT series_id, {c0} AS c0, {step} AS step, {K} AS n_folds, {h} AS h FROM n),
f AS (SELECT series_id, c0 + fold * step AS cutoff, h, fold AS k
      FROM (SELECT series_id, c0, step, h, unnest(range(0, n_folds)) AS fold FROM pl)),
m AS (SELECT f.series_id, f.k, f.cutoff, f.h, count(*) AS nn, avg(d.x) AS mx, avg(d.y) AS my,
             covar_pop(d.y, d.x) AS cxy, var_pop(d.x) AS vx
      FROM f JOIN d ON d.series_id = f.series_id AND d.t < f.cutoff AND d.x IS NOT NULL AND d.y IS NOT NULL
      GROUP BY 1, 2, 3, 4),
p AS (SELECT d.series_id, d.y,
             (m.my - (m.nn * m.cxy / ((m.nn + 5.0) * m.vx)) * m.mx) + (m.nn * m.cxy / ((m.nn + 5.0) * m.vx)) * d.x
               AS pred
      FROM m JOIN d ON d.series_id = m.series_id AND d.t >= m.cutoff AND d.t < m.cutoff + m.h
      WHERE d.x IS NOT NULL)
SELECT series_id, count(*) AS n, round(avg(abs(y - pred)), 2) AS MAE,
       round(sqrt(sum((y - pred) ^ 2) / count(*)), 2) AS RMSE,
       round(avg(CASE WHEN y <> 0 THEN abs(y - pred) / abs(y) END) * 100, 6) AS MAPE_pct
FROM p WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY 1"""


def _fold_one_feature(spark, sf, plan, **kw):
    d = add_time_index(panels.rev_panel_dense(spark, sf))
    d = d.withColumns({"x": F.array(F.lag("target", 1).over(Window.partitionBy("series_id").orderBy("period"))),
                       "y": F.col("target")})
    d = d.withColumn("eligible", F.col("x")[0].isNotNull() & F.col("y").isNotNull())
    d = lin.materialize(bt.with_plan(d, plan, ["series_id"], **kw), ["series_id"])
    sc = bt.ridge_backtest(d, ["series_id"], p=1)
    m = mt.forecast_metrics(sc, "y", "pred_target", ["series_id"], "A")
    return m.select("series_id", "n", r("MAE", 2), r("RMSE", 2), r("MAPE_pct", 6))


@register("ml7_block_backtest_one_feature", with_views(_FOLD1_SQL.format(W=W, **_BLOCK), "rev_panel_dense"))
def ml7_one(spark, sf):
    """Rolling-origin block backtest (cutoffs range(24, n-12+1, 6), 12-month
    blocks, pooled) of a one-feature ridge, level on last month's level;
    closed-form oracle per fold."""
    return _fold_one_feature(spark, sf, bt.plan_blocks, horizon=12, min_train=24, step=6)


@register("ml9_kfold_one_feature", with_views(_FOLD1_SQL.format(W=W, **_KFOLD), "rev_panel_dense"))
def ml9_one(spark, sf):
    """Time-series 4-fold CV of the same one-feature ridge, predictions
    pooled; closed-form oracle per fold."""
    return _fold_one_feature(spark, sf, bt.plan_kfold, n_splits=4)


@register("ml7_block_backtest")
def ml7(spark, sf):
    """Block backtest of ridge on level features (train part), pooled
    metrics per nation (micro average)."""
    data, feats = sel.level_dataset(panels.rev_panel_dense(spark, sf), COVS)
    data = lin.materialize(data.filter(F.col("split") == "train"), ["series_id"])
    scored = sel.block_backtest(data, "ridge", p=len(feats))
    return mt.forecast_metrics(scored, "y", "pred_target", ["series_id"], "A")


@register("ml9_kfold_cv")
def ml9(spark, sf):
    """Ridge time-series 4-fold CV on level features of the training months:
    per-fold metrics averaged (macro) next to pooled (micro)."""
    data, feats = sel.level_dataset(panels.rev_panel_dense(spark, sf), COVS)
    data = data.filter(F.col("split") == "train")
    planned = lin.materialize(bt.with_plan(data, bt.plan_kfold, ["series_id"], n_splits=4), ["series_id"])
    scored = bt.ridge_backtest(planned, ["series_id"], p=len(feats))
    return mt.macro_micro_metrics(scored, "k", "y", "pred_target", ["series_id"])


# ------------------------------------------------------------------ ML11, ML14, ML15 (given predictions)
def rule_predictions(spark, sf):
    """Given predictions: each kind's change predicted by the mean of its
    previous three values; levels reconstructed (ML11)."""
    t = dataset(spark, sf)
    t = t.withColumn("trend_next", F.regr_intercept("log_y", "t").over(
        Window.partitionBy("series_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1))
        + F.regr_slope("log_y", "t").over(
        Window.partitionBy("series_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)) * F.col("t"))
    t = t.withColumn("target_kind", F.explode(F.array(*[F.lit(k) for k in
                                                        ("mom_logdiff", "yoy_logdiff", "trend_dev")])))
    y = (F.when(F.col("target_kind") == "mom_logdiff", F.col("mom_logdiff"))
         .when(F.col("target_kind") == "yoy_logdiff", F.col("yoy_logdiff")).otherwise(F.col("trend_dev")))
    w = Window.partitionBy("series_id", "target_kind").orderBy("period").rowsBetween(-3, -1)
    t = t.withColumn("y", y).withColumn("pred_target", F.when(F.count("y").over(w) == 3, F.avg("y").over(w)))
    return reconstruct(t).select("series_id", "period", "target_kind", F.col("target").alias("actual"),
                                 "predicted")


_RULE_SQL = f"""
WITH b AS (SELECT *, regr_intercept(log_y, t) OVER wt + regr_slope(log_y, t) OVER wt * t AS trend_next
           FROM targets WINDOW wt AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT b.*, kk.target_kind,
             CASE kk.target_kind WHEN 'mom_logdiff' THEN mom_logdiff WHEN 'yoy_logdiff' THEN yoy_logdiff
                  ELSE trend_dev END AS y
      FROM b CROSS JOIN (VALUES ('mom_logdiff'), ('yoy_logdiff'), ('trend_dev')) AS kk(target_kind)),
p AS (SELECT *, CASE WHEN count(y) OVER w3 = 3 THEN avg(y) OVER w3 END AS pred_target FROM k
      WINDOW w3 AS (PARTITION BY series_id, target_kind ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
rp AS (SELECT series_id, period, target_kind, target AS actual,
              exp(CASE target_kind WHEN 'mom_logdiff' THEN log_lag1 WHEN 'yoy_logdiff' THEN log_lag12
                  ELSE trend_next END + pred_target) AS predicted FROM p)"""


@register("ml11_reconstruct", with_views(_RULE_SQL + """
SELECT series_id, period, target_kind, round(predicted, 2) AS predicted FROM rp""", "targets"))
def ml11(spark, sf):
    return rule_predictions(spark, sf).select("series_id", "period", "target_kind", r("predicted", 2))


@register("ml14_period_errors", with_views(_RULE_SQL + """
SELECT series_id, period, target_kind, round(abs(predicted - actual) / actual * 100, 6) AS abs_pct_error
FROM rp WHERE predicted IS NOT NULL AND actual <> 0""", "targets"))
def ml14(spark, sf):
    p = rule_predictions(spark, sf).filter(F.col("predicted").isNotNull() & (F.col("actual") != 0))
    return mt.period_errors(p).select("series_id", "period", "target_kind", r("abs_pct_error", 6))


_EXCL = ["1998-01", "1998-02", "1999-12"]


@register("ml15_steady_state", with_views(_RULE_SQL + f"""
SELECT series_id, target_kind, count(*) AS n,
       round(avg(abs(actual - predicted)), 2) AS MAE,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100, 6) AS MAPE_pct
FROM rp WHERE predicted IS NOT NULL AND actual IS NOT NULL
  AND strftime(period, '%Y-%m') NOT IN ({", ".join(f"'{m}'" for m in _EXCL)})
GROUP BY 1, 2""", "targets"))
def ml15(spark, sf):
    m = mt.steady_state(rule_predictions(spark, sf), _EXCL, keys=["series_id", "target_kind"])
    return m.select("series_id", "target_kind", "n", r("MAE", 2), r("MAPE_pct", 6))


# ------------------------------------------------------------------ ML13, ML16, ML19, SO6
@register("ml13_auto_select")
def ml13(spark, sf):
    """Candidates (ridge, forest, boosting, and boosting with column sampling
    and leaf penalty, per nation) scored by block backtest on the train part; best
    by RMSE; refit; train/hold-out metrics."""
    _, best, split_metrics, _ = auto_selection(spark, sf)
    return split_metrics


@register("ml19_summary")
def ml19(spark, sf):
    """Hold-out metrics of every candidate (rounded), one row per (nation, model)."""
    _, _, _, preds = auto_selection(spark, sf)
    m = mt.forecast_metrics(preds.filter(F.col("split") == "test"), "y", "prediction",
                            ["series_id", "model"], "A")
    return m.select("series_id", "model", *[F.round(c, 4).alias(c) for c in mt.METRIC_NAMES_A])


@register("ml16_feature_effects")
def ml16(spark, sf):
    """Effects of each nation's chosen model (ML13): its ridge coefficients,
    or its tree model's importances, kept from its refit."""
    _, best, _, preds = auto_selection(spark, sf)
    _, feats = sel.level_dataset(panels.rev_panel_dense(spark, sf), COVS)
    return sel.chosen_effects(preds, feats, best)


@register("so6_rank_features_two", with_views(f"""
WITH d AS (SELECT series_id, mom_logdiff AS y,
                  CAST(n_orders - lag(n_orders, 1) OVER ({W}) AS DOUBLE) AS x1,
                  avg_disc - lag(avg_disc, 1) OVER ({W}) AS x2 FROM targets),
e AS (SELECT * FROM d WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (SELECT series_id, count(*) AS n, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r12,
             covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y FROM e GROUP BY 1),
w AS (SELECT *, n * c1y / s1 AS b1, n * c2y / s2 AS b2,
             (n + 5.0) * (n + 5.0) - (n * r12) * (n * r12) AS det FROM m),
z AS (SELECT series_id, 'n_orders_chg1' AS feature, ((n + 5.0) * b1 - n * r12 * b2) / det AS importance FROM w
      UNION ALL
      SELECT series_id, 'avg_disc_chg1' AS feature, ((n + 5.0) * b2 - n * r12 * b1) / det AS importance FROM w)
SELECT series_id, feature, round(importance, 8) + 0.0 AS importance,
       CAST(row_number() OVER (PARTITION BY series_id ORDER BY abs(importance) DESC, feature) AS INTEGER) AS rank
FROM z""", "targets"))
def so6_two(spark, sf):
    """Standardised ridge coefficients of two regressors ranked by absolute
    size per nation (the ranking of ML16 effects); the 2x2 closed form gives
    the oracle."""
    d = dataset(spark, sf).withColumns({
        "x": F.array(F.col("n_orders_chg1").cast("double"), F.col("avg_disc_chg1").cast("double")),
        "y": F.col("mom_logdiff")})
    coef = lin.fit_ridge(d, alpha=5.0, p=2)
    names = F.array(F.lit("n_orders_chg1"), F.lit("avg_disc_chg1"))
    z = coef.select("series_id", F.inline(F.arrays_zip(names.alias("feature"),
                                                       F.slice("coef", 4, 2).alias("importance"))))
    ranked = rank_features(z, "importance", ["series_id"])
    return ranked.select("series_id", "feature", (F.round("importance", 8) + F.lit(0.0)).alias("importance"), "rank")


@register("so6_rank_features")
def so6(spark, sf):
    data, feats = sel.level_dataset(panels.rev_panel_dense(spark, sf), COVS)
    return rank_features(sel.feature_effects(data, feats, "ridge"), "importance", ["series_id"])


@register("ml17_hac_ols")
def ml17(spark, sf):
    """Full-sample OLS of trend_dev on covariates, their changes and month
    dummies with Newey-West errors; month effects vs January."""
    feats = [*COVS, *[f"{c}_chg1" for c in COVS], *[f"m_{k}" for k in range(2, 13)]]
    res = lin.hac_ols(dataset(spark, sf), "trend_dev", feats)
    return res.filter(F.col("feature").startswith("m_"))


_HAC1_SQL = f"""
WITH d AS (SELECT series_id, period, trend_dev AS y,
                  CAST(n_orders - lag(n_orders, 1) OVER ({W}) AS DOUBLE) AS x FROM targets),
e AS (SELECT * FROM d WHERE y IS NOT NULL AND x IS NOT NULL),
s AS (SELECT *, (x - avg(x) OVER ws) / CASE WHEN stddev_pop(x) OVER ws > 0 THEN stddev_pop(x) OVER ws ELSE 1 END AS z,
             y - avg(y) OVER ws AS yc, stddev_pop(x) OVER ws AS sd, count(*) OVER ws AS n
      FROM e WINDOW ws AS (PARTITION BY series_id)),
w AS (SELECT series_id, sum(z * yc) / sum(z * z) AS w FROM s GROUP BY 1),
g AS (SELECT s.*, s.z * (s.yc - s.z * w.w) AS g FROM s JOIN w ON s.series_id = w.series_id),
h AS (SELECT *, 0.75 * coalesce(lag(g, 1) OVER wo, 0) + 0.5 * coalesce(lag(g, 2) OVER wo, 0)
                + 0.25 * coalesce(lag(g, 3) OVER wo, 0) AS hh
      FROM g WINDOW wo AS (PARTITION BY series_id ORDER BY period)),
m AS (SELECT series_id, sum(g * g + 2 * g * hh) AS S, sum(z * z) AS zz, max(sd) AS sd FROM h GROUP BY 1)
SELECT m.series_id, 'n_orders_chg1' AS feature, round(w.w / m.sd, 8) + 0.0 AS coef,
       round(sqrt(m.S) / m.zz / m.sd, 8) AS std_err, round(w.w * m.zz / sqrt(m.S), 6) + 0.0 AS z
FROM m JOIN w ON m.series_id = w.series_id"""


@register("ml17_hac_one_feature", with_views(_HAC1_SQL, "targets"))
def ml17_one(spark, sf):
    """OLS of trend_dev on one regressor with Newey-West (Bartlett, 3 lags)
    standard errors, per nation: Gram aggregation, residual join, lagged
    score windows, meat aggregation and sandwich as in the full model; with
    one regressor the sandwich has a closed form for the oracle."""
    res = lin.hac_ols(dataset(spark, sf), "trend_dev", ["n_orders_chg1"])
    return res.select("series_id", "feature", (F.round("coef", 8) + F.lit(0.0)).alias("coef"),
                      F.round("std_err", 8).alias("std_err"), (F.round("z", 6) + F.lit(0.0)).alias("z"))


@register("ml18_nowcast_next_month")
def ml18_next(spark, sf):
    """Nowcast of the month after each nation's last month. The coming
    month's covariates are taken as known inputs; here they are the last
    observed month's values (a stand-in for published indicators)."""
    from pyspark.sql import Window as Wd
    panel = panels.rev_panel_dense(spark, sf)
    last = panel.withColumn("_rn", F.row_number().over(Wd.partitionBy("series_id").orderBy(F.col("period").desc())))
    nxt = last.filter("_rn = 1").select("series_id", F.add_months("period", 1).alias("period"), *COVS)
    return bt.nowcast_next(panel, nxt, COVS, "mom_logdiff", "ridge")


@register("ml18_nowcast")
def ml18(spark, sf):
    """Nowcast of each nation's last month (covariates known, target not):
    ridge on MoM log change refitted on all earlier months."""
    return bt.nowcast(dataset(spark, sf), COVS, "mom_logdiff", "ridge")
