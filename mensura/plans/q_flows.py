"""Catalog: composite data flows FW1-FW10."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.clean import MONTH_ABBR, month_start, parse_date, parse_money
from mensura.operators import aggregate as ag
from mensura.operators import backtest as bt
from mensura.operators import filters as fl
from mensura.operators import linear as lin
from mensura.operators import metrics as mt
from mensura.operators import reshape as rs
from mensura.operators import selection as sel
from mensura.operators.windows import add_yoy_pct
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.flows import delevel_dataset, level_features
from mensura.plans.q_models import auto_selection, walk_forward_predictions
from mensura.plans.q_reshape import _order_covs, _ship_covs
from mensura.plans.registry import register
from mensura.plans.util import money_mean_4, r, sql_money_mean_4
from mensura.session import scratch_dir
from mensura.sources import csv_io

COVS = panels.REV_COVARIATES
W = "PARTITION BY series_id ORDER BY period"


# ------------------------------------------------------------------ FW1
def monthly_series_from_wide(spark, sf):
    """Wide money text -> parsed (SC1) -> long (RS1) -> dated (SC8) -> one
    series per month (AG1, exact decimal sum)."""
    w = panels.rev_wide(spark, sf)
    long = rs.wide_to_long(w, ["series_id", "Year"], MONTH_ABBR, "Month", "Value")
    long = long.withColumns({"Value": parse_money("Value"), "period": month_start("Year", "Month")})
    long = fl.drop_null(long, ["Value"])
    return long, ag.aggregate_series(long, ["period"], "Value", "total", scale=2)


_FW1_SERIES = "(SELECT period, CAST(SUM(CAST(target AS DECIMAL(38,2))) AS DOUBLE) AS total FROM rev_panel GROUP BY 1)"


@register("fw1_eda_report", with_views(f"""
WITH s AS {_FW1_SERIES},
sp AS (SELECT CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP),
              INTERVAL 1 MONTH)) AS DATE) AS period FROM s)
SELECT CAST(count(*) AS BIGINT) AS count, """ + sql_money_mean_4("total") + """ AS mean, round(stddev_samp(total), 4) AS std,
       min(total) AS min, round(quantile_cont(total, 0.25), 4) AS p25, round(quantile_cont(total, 0.5), 4) AS p50,
       round(quantile_cont(total, 0.75), 4) AS p75, max(total) AS max,
       min(period) AS first_period, max(period) AS last_period,
       (SELECT CAST(count(*) AS BIGINT) FROM sp WHERE period NOT IN (SELECT period FROM s)) AS n_missing,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT count(*) OVER (PARTITION BY series_id, period) AS c
                                              FROM rev_panel) WHERE c > 1) AS n_duplicate_rows,
       (SELECT coalesce(max(abs(round(sm - fy, 2))), 0.0) + 0.0 FROM (
          SELECT year(period) AS y, sum(target) AS sm,
                 sum(CAST(target AS DECIMAL(18,2))) AS fy_dec, CAST(sum(CAST(target AS DECIMAL(18,2))) AS DOUBLE) AS fy
          FROM rev_panel GROUP BY 1)) AS max_abs_diff
FROM s""", "rev_panel"))
def fw1(spark, sf):
    """EDA report of the monthly series built from the wide text table:
    describe (AG4), span (AG5), missing months (JN3), duplicate rows on the
    long table (AG7), and the largest |sum of months - reported total| (AG3)."""
    long, series = monthly_series_from_wide(spark, sf)
    series = series.withColumn("series_id", F.lit("all"))
    d = ag.describe_series(series, "total").join(ag.span(series), "series_id").join(
        series.groupBy("series_id").agg(money_mean_4("total").alias("mean4")), "series_id")
    # distinct month starts: months on the spine minus months present
    d = d.withColumn("n_missing", (F.months_between("last_period", "first_period").cast("bigint") + 1
                                   - F.col("count")))
    dups = ag.duplicate_periods(long, ["series_id", "period"]).agg(
        F.count(F.lit(1)).alias("n_duplicate_rows")).withColumn("series_id", F.lit("all"))
    w = panels.rev_wide(spark, sf).withColumn("FY_Total", parse_money("FY Total"))
    rec = ag.reconcile(ag.year_total(w, MONTH_ABBR, ["Year"]), w, ["Year"], "SumOfMonths", "FY_Total")
    diff = rec.agg(F.coalesce(F.max(F.abs(F.round("Diff", 2))), F.lit(0.0)).alias("max_abs_diff")) \
        .withColumn("series_id", F.lit("all"))
    out = d.join(dups, "series_id").join(diff, "series_id")  # one-row frames on a constant key
    return out.select("count", F.col("mean4").alias("mean"), r("std", 4), "min", r("p25", 4), r("p50", 4), r("p75", 4), "max",
                      "first_period", "last_period", "n_missing", "n_duplicate_rows",
                      (F.col("max_abs_diff") + F.lit(0.0)).alias("max_abs_diff"))


# ------------------------------------------------------------------ FW2
_WIDE_DDL = "series_id string, Year int, " + ", ".join(f"{m} double" for m in MONTH_ABBR)


@register("fw2_index_series", with_views(
    "SELECT series_id, period, avg_disc AS value FROM rev_panel ORDER BY series_id, period", "rev_panel"))
def fw2(spark, sf):
    """Index wide table behind an 11-line preamble (SRC2) -> long (RS1) ->
    dated (SC8) -> sorted (SO1)."""
    p = panels.rev_panel(spark, sf).select("series_id", F.year("period").alias("Year"),
                                           F.date_format("period", "MMM").alias("mon"), "avg_disc")
    wide = rs.long_to_wide(p, ["series_id", "Year"], "mon", "avg_disc", MONTH_ABBR)
    lines = csv_io.csv_lines(wide.select("series_id", "Year", *MONTH_ABBR))
    pre = [f"Index export, line {i}" for i in range(1, 11)] + ["Series Id: all nations"]
    path = csv_io.write_text_with_header(lines, scratch_dir(spark, "fw2"),
                                         pre + [",".join(["series_id", "Year", *MONTH_ABBR])])
    back = csv_io.read_csv_skip(spark, path, 11, _WIDE_DDL)
    long = rs.wide_to_long(back, ["series_id", "Year"], MONTH_ABBR, "Month", "value")
    long = long.filter(F.col("value").isNotNull()).withColumn("period", month_start("Year", "Month"))
    return long.select("series_id", "period", "value").orderBy("series_id", "period")


# ------------------------------------------------------------------ FW3
@register("fw3_model_table", with_views("""
SELECT r.period, r.series_id, r.target AS revenue, r.n_orders, round(a.avg_order_price, 4) AS avg_order_price,
       b.n_shipped
FROM rev_panel r
LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, avg(o_totalprice) AS avg_order_price
           FROM orders GROUP BY 1) a ON r.period = a.period
LEFT JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, count(*) AS n_shipped
           FROM lineitem GROUP BY 1) b ON r.period = b.period""", "rev_panel"))
def fw3(spark, sf):
    """Two covariate left joins (JN1) and a rename/reorder (SC14)."""
    base = panels.rev_panel(spark, sf).select("series_id", "period", "target", "n_orders")
    j = rs.join_covariates(base, _order_covs(spark, sf), ["period"], ["avg_order_price"])
    j = rs.join_covariates(j, _ship_covs(spark, sf), ["period"], ["n_shipped"])
    j = j.withColumn("avg_order_price", F.round("avg_order_price", 4))
    return fl.project(j, {"target": "revenue"}, first=["period"])


# ------------------------------------------------------------------ FW4
@register("fw4_clean_file", with_views("SELECT series_id, period, target FROM rev_panel", "rev_panel"))
def fw4(spark, sf):
    """Raw region file (``M/d/yy`` dates, blank rows) -> strict date parse
    (SC4) -> blank rows dropped (FL3) -> clean CSV written (SNK1) -> read."""
    p = panels.rev_panel(spark, sf).select("series_id", F.date_format("period", "M/d/yy").alias("date"), "target")
    blank = spark.range(1).select(F.lit(None).cast("string").alias("series_id"),
                                  F.lit(None).cast("string").alias("date"),
                                  F.lit(None).cast("double").alias("target"))  # one blank row
    raw_path = csv_io.write_csv(p.unionByName(blank), scratch_dir(spark, "fw4raw"))
    raw = spark.read.option("header", True).csv(raw_path)
    clean = fl.drop_blank_rows(raw).select(
        "series_id", parse_date("date", ["M/d/yy"], strict=True).alias("period"),
        F.col("target").try_cast("double").alias("target"))
    out = csv_io.write_csv(clean, scratch_dir(spark, "fw4clean"))
    return csv_io.read_series_csv(spark, out, {"period": "date", "target": "double"})


# ------------------------------------------------------------------ FW5
_FW5_FEATS = ["month", "quarter", "month_sin", "month_cos", "target_lag1", "target_lag2", "target_lag3",
              "target_lag12", "target_roll3_mean", "target_roll12_mean", "target_prev_yoy_pct"]


@register("fw5_level_features", with_views(f"""
WITH f AS (SELECT series_id, period, target, {", ".join(COVS)},
  month(period) AS month, quarter(period) AS quarter,
  sin(2 * pi() * month(period) / 12.0) AS month_sin, cos(2 * pi() * month(period) / 12.0) AS month_cos,
  lag(target, 1) OVER ({W}) AS target_lag1, lag(target, 2) OVER ({W}) AS target_lag2,
  lag(target, 3) OVER ({W}) AS target_lag3, lag(target, 12) OVER ({W}) AS target_lag12,
  CASE WHEN count(target) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
       THEN avg(target) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS target_roll3_mean,
  CASE WHEN count(target) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) = 12
       THEN avg(target) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS target_roll12_mean,
  (lag(target, 1) OVER ({W}) - lag(target, 13) OVER ({W})) / lag(target, 13) OVER ({W}) AS target_prev_yoy_pct
  FROM rev_panel_dense)
SELECT series_id, period, CAST(month AS INTEGER) AS month, CAST(quarter AS INTEGER) AS quarter,
       round(month_sin, 9) + 0.0 AS month_sin, round(month_cos, 9) + 0.0 AS month_cos,
       target, {", ".join(COVS)}, target_lag1, target_lag2, target_lag3, target_lag12, round(target_roll3_mean, 4) AS target_roll3_mean,
       round(target_roll12_mean, 4) AS target_roll12_mean, round(target_prev_yoy_pct, 9) AS target_prev_yoy_pct
FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in COVS + _FW5_FEATS + ["target"])}""", "rev_panel_dense"))
def fw5(spark, sf):
    d, _ = level_features(panels.rev_panel_dense(spark, sf), COVS)
    return d.select("series_id", "period", "month", "quarter", (F.round("month_sin", 9) + F.lit(0.0)).alias("month_sin"),
                    (F.round("month_cos", 9) + F.lit(0.0)).alias("month_cos"), "target", *COVS,
                    "target_lag1", "target_lag2", "target_lag3", "target_lag12",
                    r("target_roll3_mean", 4), r("target_roll12_mean", 4), r("target_prev_yoy_pct", 9))


@register("fw5_warmup_report", with_views(f"""
WITH f AS (SELECT series_id, period, target, {", ".join(COVS)},
  lag(target, 1) OVER ({W}) AS l1, lag(target, 2) OVER ({W}) AS l2, lag(target, 3) OVER ({W}) AS l3,
  lag(target, 12) OVER ({W}) AS l12, lag(target, 13) OVER ({W}) AS l13,
  count(target) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c3,
  count(target) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS c12
  FROM rev_panel_dense),
a AS (SELECT series_id, count(*) AS rows_after, min(period) AS first_usable FROM f
      WHERE {" AND ".join(f"{c} IS NOT NULL" for c in COVS)} AND target IS NOT NULL AND l1 IS NOT NULL
        AND l2 IS NOT NULL AND l3 IS NOT NULL AND l12 IS NOT NULL AND l13 IS NOT NULL
        AND c3 = 3 AND c12 = 12 AND l13 <> 0
      GROUP BY 1),
b AS (SELECT series_id, count(*) AS rows_before FROM rev_panel_dense GROUP BY 1)
SELECT b.series_id, b.rows_before, coalesce(a.rows_after, 0) AS rows_after, a.first_usable,
       b.rows_before - coalesce(a.rows_after, 0) AS rows_dropped
FROM b LEFT JOIN a ON a.series_id = b.series_id""", "rev_panel_dense"))
def fw5_warmup(spark, sf):
    """How many months the level-feature warm-up really drops per nation
    (lags up to 13 and the 12-month trailing mean)."""
    from mensura.plans.flows import warmup_report
    panel = panels.rev_panel_dense(spark, sf)
    featured, _ = level_features(panel, COVS)
    return warmup_report(panel, featured)


# ------------------------------------------------------------------ FW6
@register("fw6_delevel_dataset", with_views(f"""
SELECT series_id, period, t, round(mom_logdiff, 10) AS mom_logdiff, round(yoy_logdiff, 10) AS yoy_logdiff,
       round(trend_dev, 8) + 0.0 AS trend_dev, target, """ + ", ".join(COVS) + ", " + ", ".join(
    f"CASE WHEN month(period) = {k} THEN 1 ELSE 0 END AS m_{k}" for k in range(2, 13)) + ", " + ", ".join(
    f"round(CAST({c} - lag({c}, {k}) OVER ({W}) AS DOUBLE), 9) + 0.0 AS {c}_chg{k}" for c in COVS for k in (1, 12))
    + " FROM targets", "targets"))
def fw6(spark, sf):
    d = delevel_dataset(panels.rev_panel_dense(spark, sf), COVS)
    return d.select("series_id", "period", "t", r("mom_logdiff", 10), r("yoy_logdiff", 10),
                    (F.round("trend_dev", 8) + F.lit(0.0)).alias("trend_dev"), "target", *COVS,
                    *[f"m_{k}" for k in range(2, 13)], *[(F.round(F.col(f"{c}_chg{k}").cast("double"), 9) + F.lit(0.0)).alias(f"{c}_chg{k}")
                                     for c in COVS for k in (1, 12)])


# ------------------------------------------------------------------ FW7-FW10 (model flows)
@register("fw7_auto_select_errors")
def fw7(spark, sf):
    """Auto-select flow: candidates by block backtest, best per nation,
    refit, then the hold-out per-month errors of the chosen model (ML14)."""
    _, best, _, preds = auto_selection(spark, sf)
    chosen = preds.join(best, "series_id").filter((F.col("model") == F.col("best_model"))
                                                  & (F.col("split") == "test"))
    e = mt.period_errors(chosen, "y", "prediction")
    return e.select("series_id", "period", "best_model", "y", "prediction", "abs_pct_error")


@register("fw7_auto_select_report")
def fw7_report(spark, sf):
    """Auto-select report per nation: chosen model (ML7 + AG12), hold-out
    metrics of the refit (ML13), steady-state hold-out MAPE without the first
    hold-out month (ML15), and the share of hold-out months above the
    training maximum (AG8)."""
    _, best, split_metrics, preds = auto_selection(spark, sf)
    chosen = preds.join(best, "series_id").filter(F.col("model") == F.col("best_model"))
    test = chosen.filter(F.col("split") == "test")
    first_test = test.groupBy("series_id").agg(F.min("period").alias("_first"))
    steady = mt.forecast_metrics(test.join(first_test, "series_id").filter(F.col("period") > F.col("_first")),
                                 "y", "prediction", ["series_id"], "A").select(
        "series_id", F.col("MAPE_pct").alias("steady_MAPE_pct"))
    above = ag.share_above_train_max(chosen.filter(F.col("split") != "error"), "y").select(
        "series_id", "pct_above_train_max")
    hold = split_metrics.filter(F.col("split") == "test").select(
        "series_id", "best_model", "R2", "MAE", "RMSE", "MAPE_pct", "sMAPE_pct")
    return hold.join(steady, "series_id", "left").join(above, "series_id", "left")


@register("fw8_delevel_grid")
def fw8(spark, sf):
    """De-levelled grid: ridge, forest and boosting walk-forward over the last
    24 months for every target kind, ranked by MAPE per nation with PASS/fail
    verdicts; a failing combo keeps its ``error``."""
    preds = walk_forward_predictions(spark, sf, ["ridge", "forest", "boosting"])
    m = mt.forecast_metrics(preds, keys=["series_id", "target_kind", "model"], which="B")
    m = m.withColumn("combo", F.concat_ws(" | ", "target_kind", "model"))
    return mt.threshold_check(mt.rank_combos(m, "MAPE_pct", "combo"))


@register("fw8_month_effects")
def fw8_effects(spark, sf):
    """Last step of the grid flow: month effects against January (ML17)."""
    feats = [*COVS, *[f"{c}_chg1" for c in COVS], *[f"m_{k}" for k in range(2, 13)]]
    effects = lin.hac_ols(delevel_dataset(panels.rev_panel_dense(spark, sf), COVS), "trend_dev", feats)
    return effects.filter(F.col("feature").startswith("m_"))


@register("fw9_nowcast_forest")
def fw9(spark, sf):
    """Nowcast flow for the month after each nation's last: YoY log change
    with a forest refitted on all its months; level reconstructed from the
    same month a year before. The coming month's covariates are inputs; here
    they are the last month's values (a stand-in for published indicators)."""
    panel = panels.rev_panel_dense(spark, sf)
    last = panel.groupBy("series_id").agg(F.max_by(F.struct(*COVS), "period").alias("c"),
                                          F.add_months(F.max("period"), 1).alias("period"))
    coming = last.select("series_id", "period", "c.*")
    return bt.nowcast_next(panel, coming, COVS, "yoy_logdiff", "forest", profile="delevel")


@register("fw10_tree_comparison")
def fw10(spark, sf):
    """Tree comparison: level features (plus the current-row YoY change,
    which leaks the target and is kept only to reproduce that comparison),
    12-month hold-out; per model the mean metrics of a 4-fold time-series CV
    on the training months, in-sample and hold-out metrics; best by hold-out
    R2."""
    panel = add_yoy_pct(panels.rev_panel_dense(spark, sf), "target")
    data, _ = sel.level_dataset(panel, COVS + ["target_yoy_pct"])
    data = lin.materialize(data.filter(F.col("split") != "error"), ["series_id"])
    train = data.filter(F.col("split") == "train")
    rows = []
    for m in ("forest", "boosting", "boosting_colsample"):
        planned = bt.with_plan(train, bt.plan_kfold, ["series_id"], n_splits=4)
        scored = lin.materialize(bt.backtest(planned, ["series_id"], m, profile="comparison").select(
            "series_id", "k", "y", "pred_target"), ["series_id"])
        cv = mt.forecast_metrics(scored, "y", "pred_target", ["series_id", "k"], "A").groupBy("series_id").agg(
            *[F.avg(c).alias(f"cv_{c}") for c in mt.METRIC_NAMES_A])
        fitted = lin.materialize(sel.refit_predict(data, m, profile="comparison")
                                 .select("series_id", "split", "y", "prediction"), ["series_id"])
        inside = mt.forecast_metrics(fitted.filter(F.col("split") == "train"), "y", "prediction", ["series_id"], "A")
        hm = mt.forecast_metrics(fitted.filter(F.col("split") == "test"), "y", "prediction", ["series_id"], "A")
        rows.append(hm.join(cv, "series_id", "left").join(inside.select(
            "series_id", *[F.col(c).alias(f"train_{c}") for c in mt.METRIC_NAMES_A]), "series_id", "left")
            .withColumn("model", F.lit(m)))
    allm = rows[0].unionByName(rows[1]).unionByName(rows[2])
    allm = lin.materialize(allm, ["series_id"])
    best = mt.select_best(allm, "R2", "model", ["series_id"], "max").select(
        "series_id", F.col("model").alias("best_model"))
    return allm.join(best, "series_id")
