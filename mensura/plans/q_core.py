"""Catalog: flagship slice, windows (WN), aggregates (AG), sorts (SO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import aggregate as ag
from mensura.operators import metrics as mt
from mensura.operators import windows as wn
from mensura.operators.reconstruct import zero_change_forecasts
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.registry import register
from mensura.plans.util import money_mean_4, r, sql_money_mean_4

W = "PARTITION BY series_id ORDER BY period"


def targets(spark, sf):
    return wn.build_targets(panels.rev_panel_dense(spark, sf))


def zero_fc(spark, sf, n_test=12):
    return zero_change_forecasts(targets(spark, sf), n_test)


# --------------------------------------------------------------- flagship
def level_metrics(spark, sf):
    """rev_panel -> dense spine -> targets -> zero-change forecasts of the
    last 12 months (three anchors) -> R2 / MAPE / RMSE per nation and kind ->
    rank per nation (1 = lowest MAPE)."""
    m = mt.forecast_metrics(zero_fc(spark, sf), keys=["series_id", "target_kind"], which="B")
    ranked = mt.rank_combos(m, by="MAPE_pct", name="target_kind")
    return ranked.select("series_id", "target_kind", "n", r("R2", 6), r("MAPE_pct", 6),
                         r("RMSE", 2), "rank")


_METRICS_B_SQL = """
SELECT series_id, target_kind, count(*) AS n,
       CASE WHEN var_pop(actual) * count(*) > 0
            THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END AS R2,
       avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100 AS MAPE_pct,
       sqrt(sum((actual - predicted) ^ 2) / count(*)) AS RMSE
FROM zero_fc WHERE actual IS NOT NULL AND predicted IS NOT NULL
GROUP BY 1, 2"""

register("ag10_level_metrics", with_views(f"""
SELECT series_id, target_kind, n, round(R2, 6) AS R2, round(MAPE_pct, 6) AS MAPE_pct,
       round(RMSE, 2) AS RMSE,
       CAST(row_number() OVER (PARTITION BY series_id ORDER BY MAPE_pct ASC NULLS LAST,
                               target_kind) AS INTEGER) AS rank
FROM ({_METRICS_B_SQL})""", "zero_fc"))(level_metrics)


@register("ag9_forecast_metrics", with_views("""
SELECT series_id, target_kind, count(*) AS n,
       round(CASE WHEN var_pop(actual) * count(*) > 0
            THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END, 6) AS R2,
       round(avg(abs(actual - predicted)), 2) AS MAE,
       round(sqrt(sum((actual - predicted) ^ 2) / count(*)), 2) AS RMSE,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100, 6) AS MAPE_pct,
       round(avg(2 * abs(predicted - actual) / (abs(actual) + abs(predicted) + 1e-9)) * 100, 6) AS sMAPE_pct
FROM zero_fc WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2""", "zero_fc"))
def ag9(spark, sf):
    m = mt.forecast_metrics(zero_fc(spark, sf), keys=["series_id", "target_kind"], which="A")
    return m.select("series_id", "target_kind", "n", r("R2", 6), r("MAE", 2), r("RMSE", 2),
                    r("MAPE_pct", 6), r("sMAPE_pct", 6))


@register("ag11_macro_micro", with_views("""
WITH f AS (SELECT *, CAST(date_trunc('quarter', period) AS DATE) AS fold FROM zero_fc
           WHERE actual IS NOT NULL AND predicted IS NOT NULL),
pf AS (SELECT series_id, target_kind, fold,
              CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END AS R2,
              sqrt(sum((actual - predicted) ^ 2) / count(*)) AS RMSE,
              avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100 AS MAPE_pct
       FROM f GROUP BY 1, 2, 3),
ma AS (SELECT series_id, target_kind, avg(R2) AS macro_R2, avg(RMSE) AS macro_RMSE,
              avg(MAPE_pct) AS macro_MAPE_pct FROM pf GROUP BY 1, 2),
mi AS (SELECT series_id, target_kind,
              CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END AS micro_R2,
              sqrt(sum((actual - predicted) ^ 2) / count(*)) AS micro_RMSE,
              avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100 AS micro_MAPE_pct
       FROM f GROUP BY 1, 2)
SELECT ma.series_id, ma.target_kind, round(macro_R2, 6) AS macro_R2, round(macro_RMSE, 2) AS macro_RMSE,
       round(macro_MAPE_pct, 6) AS macro_MAPE_pct, round(micro_R2, 6) AS micro_R2,
       round(micro_RMSE, 2) AS micro_RMSE, round(micro_MAPE_pct, 6) AS micro_MAPE_pct
FROM ma JOIN mi ON ma.series_id = mi.series_id AND ma.target_kind = mi.target_kind""", "zero_fc"))
def ag11(spark, sf):
    fc = zero_fc(spark, sf).withColumn("fold", F.trunc("period", "quarter"))
    m = mt.macro_micro_metrics(fc, fold="fold", keys=["series_id", "target_kind"])
    cols = [f"{p}_{m_}" for p in ("macro", "micro") for m_ in ("R2", "RMSE", "MAPE_pct")]
    return m.select("series_id", "target_kind",
                    *[r(c, 2 if c.endswith("RMSE") else 6) for c in cols])


@register("ag12_select_best", with_views(f"""
SELECT series_id, target_kind AS best_kind, round(MAPE_pct, 6) AS MAPE_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY MAPE_pct ASC NULLS LAST, target_kind) AS rn
  FROM ({_METRICS_B_SQL})) WHERE rn = 1""", "zero_fc"))
def ag12(spark, sf):
    m = mt.forecast_metrics(zero_fc(spark, sf), keys=["series_id", "target_kind"], which="B")
    b = mt.select_best(m, by="MAPE_pct", name="target_kind")
    return b.select("series_id", F.col("target_kind").alias("best_kind"), r("MAPE_pct", 6))


@register("so4_rank_combos", with_views(f"""
SELECT series_id, target_kind, CAST(row_number() OVER (PARTITION BY series_id
       ORDER BY MAPE_pct ASC NULLS LAST, target_kind) AS INTEGER) AS rank,
       CASE WHEN R2 > 0.93 AND MAPE_pct < 3.5 AND RMSE < 8000000 THEN 'PASS' ELSE 'fail' END AS verdict
FROM ({_METRICS_B_SQL})""", "zero_fc"))
def so4(spark, sf):
    m = mt.forecast_metrics(zero_fc(spark, sf), keys=["series_id", "target_kind"], which="B")
    m = mt.threshold_check(mt.rank_combos(m, by="MAPE_pct", name="target_kind"))
    return m.select("series_id", "target_kind", "rank", "verdict")


@register("sc13_threshold_check", with_views(f"""
SELECT series_id, target_kind,
       CASE WHEN R2 > 0.5 AND MAPE_pct < thr_mape AND RMSE < thr_rmse THEN 'PASS' ELSE 'fail' END AS verdict
FROM (SELECT m.*, 10.0 AS thr_mape, 0.1 * s.mean_target AS thr_rmse
      FROM ({_METRICS_B_SQL}) m
      JOIN (SELECT series_id, avg(target) AS mean_target FROM rev_panel_dense GROUP BY 1) s
        ON m.series_id = s.series_id)""", "zero_fc"))
def sc13(spark, sf):
    """Per-series bars: RMSE must be under 10 % of the series' mean level."""
    m = mt.forecast_metrics(zero_fc(spark, sf), keys=["series_id", "target_kind"], which="B")
    bars = panels.rev_panel_dense(spark, sf).groupBy("series_id").agg(
        (F.avg("target") * 0.1).alias("thr_rmse"))
    m = m.join(bars, "series_id")
    return mt.threshold_check(m, r2_min=0.5, mape_max=10.0, rmse_max=F.col("thr_rmse")).select(
        "series_id", "target_kind", "verdict")


# --------------------------------------------------------------- windows
@register("wn1_lags", with_views(f"""
SELECT series_id, period, target, lag(target, 1) OVER ({W}) AS target_lag1,
       lag(target, 2) OVER ({W}) AS target_lag2, lag(target, 3) OVER ({W}) AS target_lag3,
       lag(target, 12) OVER ({W}) AS target_lag12, lag(target, 13) OVER ({W}) AS target_lag13
FROM rev_panel_dense""", "rev_panel_dense"))
def wn1(spark, sf):
    d = wn.add_lags(panels.rev_panel_dense(spark, sf), "target")
    return d.select("series_id", "period", "target", *[f"target_lag{k}" for k in (1, 2, 3, 12, 13)])


@register("wn1_lags_calendar", with_views("""
SELECT a.series_id, a.period, a.target, b.target AS target_lag12
FROM rev_panel a LEFT JOIN rev_panel b
  ON a.series_id = b.series_id AND b.period = CAST(a.period - INTERVAL 12 MONTH AS DATE)""",
                                          "rev_panel"))
def wn1_cal(spark, sf):
    """Gap-aware lag on the sparse panel: the value exactly 12 months back."""
    d = wn.add_lags(panels.rev_panel(spark, sf), "target", [12], calendar=True)
    return d.select("series_id", "period", "target", "target_lag12")


@register("wn2_trailing_mean", with_views(f"""
SELECT series_id, period,
  round(CASE WHEN count(target) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
        THEN avg(target) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END, 4) AS target_roll3_mean,
  round(CASE WHEN count(target) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) = 12
        THEN avg(target) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END, 4) AS target_roll12_mean
FROM rev_panel_dense""", "rev_panel_dense"))
def wn2(spark, sf):
    d = wn.add_trailing_mean(panels.rev_panel_dense(spark, sf), "target")
    return d.select("series_id", "period", r("target_roll3_mean", 4), r("target_roll12_mean", 4))


_COVS = panels.REV_COVARIATES


@register("wn3_diffs", with_views(f"""
SELECT series_id, period, """ + ", ".join(
    f"round(CAST({c} - lag({c}, {k}) OVER ({W}) AS DOUBLE), 9) + 0.0 AS {c}_chg{k}" for c in _COVS for k in (1, 12))
    + " FROM rev_panel_dense", "rev_panel_dense"))
def wn3(spark, sf):
    d = wn.add_diffs(panels.rev_panel_dense(spark, sf), _COVS, (1, 12))
    return d.select("series_id", "period", *[F.round(F.col(f"{c}_chg{k}").cast("double"), 9)
                                             .alias(f"{c}_chg{k}") for c in _COVS for k in (1, 12)])


@register("wn4_prev_yoy", with_views(f"""
SELECT series_id, period,
  round((lag(target, 1) OVER ({W}) - lag(target, 13) OVER ({W})) / lag(target, 13) OVER ({W}), 9)
    AS target_prev_yoy_pct
FROM rev_panel_dense""", "rev_panel_dense"))
def wn4(spark, sf):
    d = wn.add_prev_yoy(panels.rev_panel_dense(spark, sf), "target")
    return d.select("series_id", "period", r("target_prev_yoy_pct", 9))


@register("wn5_yoy_pct", with_views(f"""
SELECT series_id, period, round(target / lag(target, 12) OVER ({W}) - 1, 9) AS target_yoy_pct
FROM rev_panel_dense""", "rev_panel_dense"))
def wn5(spark, sf):
    d = wn.add_yoy_pct(panels.rev_panel_dense(spark, sf), "target")
    return d.select("series_id", "period", r("target_yoy_pct", 9))


@register("wn6_local_features", with_views(f"""
SELECT series_id, period,
  lag(n_orders, 1) OVER ({W}) AS ridership_lag1, lag(n_orders, 12) OVER ({W}) AS ridership_lag12,
  round((lag(n_orders, 1) OVER ({W}) - lag(n_orders, 12) OVER ({W}))
        / (lag(n_orders, 12) OVER ({W}) + 1e-9), 9) AS ridership_yoy,
  lag(n_customers, 1) OVER ({W}) AS shop_count_lag1, lag(quantity, 1) OVER ({W}) AS net_new_lag1,
  lag(avg_disc, 1) OVER ({W}) AS sentiment_lag1,
  round(CASE WHEN count(avg_disc) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
        THEN avg(avg_disc) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END, 9) AS sentiment_roll3
FROM rev_panel_dense""", "rev_panel_dense"))
def wn6(spark, sf):
    d = wn.add_local_features(panels.rev_panel_dense(spark, sf), ridership=("n_orders",),
                              shops=("n_customers",), net_new=("quantity",),
                              sentiment=("avg_disc",))
    return d.select("series_id", "period", F.col("ridership_lag1"), F.col("ridership_lag12"),
                    r("ridership_yoy", 9), "shop_count_lag1", "net_new_lag1", "sentiment_lag1",
                    r("sentiment_roll3", 9))


@register("wn7_time_index", with_views(f"""
SELECT series_id, period, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS t FROM rev_panel""",
                                       "rev_panel"))
def wn7(spark, sf):
    return wn.add_time_index(panels.rev_panel(spark, sf)).select("series_id", "period", "t")


@register("wn8_trend_dev", with_views("""
SELECT series_id, period, round(trend, 8) AS trend_full, round(log_y - trend, 8) AS trend_dev
FROM (SELECT *, regr_intercept(log_y, t) OVER (PARTITION BY series_id)
                + regr_slope(log_y, t) OVER (PARTITION BY series_id) * t AS trend FROM targets)""", "targets"))
def wn8(spark, sf):
    """Full-sample trend and the deviation from it."""
    return wn.build_targets(panels.rev_panel_dense(spark, sf), trend="full").select("series_id", "period", r("trend_full", 8), r("trend_dev", 8))


@register("wn9_expanding_trend", with_views(f"""
SELECT series_id, period,
  round(regr_intercept(log_y, t) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   + regr_slope(log_y, t) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * t, 8)
   AS trend_next
FROM targets""", "targets"))
def wn9(spark, sf):
    d = wn.add_expanding_trend(targets(spark, sf))
    return d.select("series_id", "period", r("trend_next", 8))


@register("wn10_targets", with_views("""
SELECT series_id, period, t, round(log_y, 10) AS log_y, round(mom_logdiff, 10) AS mom_logdiff,
       round(yoy_logdiff, 10) AS yoy_logdiff, round(trend_dev, 8) + 0.0 AS trend_dev FROM targets""",
                                     "targets"))
def wn10(spark, sf):
    return targets(spark, sf).select("series_id", "period", "t", r("log_y", 10),
                                     r("mom_logdiff", 10), r("yoy_logdiff", 10),
                                     (F.round("trend_dev", 8) + F.lit(0.0)).alias("trend_dev"))


@register("jn4_anchor", with_views(f"""
SELECT series_id, period, round(log_y, 10) AS log_y,
       round(lag(log_y, 1) OVER ({W}), 10) AS log_lag1,
       round(lag(log_y, 12) OVER ({W}), 10) AS log_lag12
FROM targets""", "targets"))
def jn4(spark, sf):
    d = targets(spark, sf)
    d = wn.anchor(wn.anchor(d, "log_y", 1, name="a1"), "log_y", 12, name="a12")
    return d.select("series_id", "period", r("log_y", 10), r("a1", 10, "log_lag1"),
                    r("a12", 10, "log_lag12"))


# --------------------------------------------------------------- aggregates
@register("ag1_aggregate_series", with_views("""
SELECT period, CAST(SUM(CAST(target AS DECIMAL(38,2))) AS DOUBLE) AS total
FROM rev_panel GROUP BY 1""", "rev_panel"))
def ag1(spark, sf):
    return ag.aggregate_series(panels.rev_panel(spark, sf), ["period"], "target", "total", scale=2)


@register("ag4_describe", with_views("""
SELECT series_id, CAST(count(target) AS BIGINT) AS count, """ + sql_money_mean_4("target") + """ AS mean,
       round(stddev_samp(target), 4) AS std, min(target) AS min,
       round(quantile_cont(target, 0.25), 4) AS p25, round(quantile_cont(target, 0.5), 4) AS p50,
       round(quantile_cont(target, 0.75), 4) AS p75, max(target) AS max
FROM rev_panel GROUP BY 1""", "rev_panel"))
def ag4(spark, sf):
    p = panels.rev_panel(spark, sf)
    d = ag.describe_series(p).join(p.groupBy("series_id").agg(money_mean_4("target").alias("mean4")),
                                   "series_id")
    return d.select("series_id", "count", F.col("mean4").alias("mean"), r("std", 4), "min", r("p25", 4),
                    r("p50", 4), r("p75", 4), "max")


@register("ag5_span", with_views("""
SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows, min(period) AS first_period,
       max(period) AS last_period FROM rev_panel GROUP BY 1""", "rev_panel"))
def ag5(spark, sf):
    return ag.span(panels.rev_panel(spark, sf))


def shifted_events(spark, sf):
    """Events with ts moved by 2*user_id months so several months, and empty
    months between them, occur per event type."""
    from mensura.sources.tables import table
    e = table(spark, sf, "events", "ts", "user_id", "event_type", "value")
    return e.select(F.col("event_type").alias("series_id"),
                    F.expr("ts + make_interval(0, cast(2 * user_id as int))").alias("ts"), "value")


_AG6_SQL = """
WITH e AS (SELECT event_type AS series_id, ts + to_months(CAST(2 * user_id AS INTEGER)) AS ts, value
           FROM events),
a AS (SELECT series_id, CAST(date_trunc('month', ts) AS DATE) AS period, avg(value) AS value
      FROM e GROUP BY 1, 2),
s AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP),
             CAST(max(period) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period
      FROM a GROUP BY 1)
SELECT s.series_id, s.period, round(a.value, 6) AS value
FROM s LEFT JOIN a ON s.series_id = a.series_id AND s.period = a.period"""


@register("ag6_resample_monthly", _AG6_SQL)
def ag6(spark, sf):
    d = ag.resample_monthly(shifted_events(spark, sf), "ts", "value")
    return d.select("series_id", "period", r("value", 6))


@register("ag7_duplicate_periods", """
SELECT o_orderkey, o_custkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
       CAST(count(*) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) AS BIGINT) AS n_copies
FROM orders QUALIFY n_copies > 1""")
def ag7(spark, sf):
    from mensura.sources.tables import table
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", F.col("o_custkey").alias("series_id"),
        F.trunc("o_orderdate", "MM").alias("period"))
    return ag.duplicate_periods(o)


@register("ag8_share_above_train_max", with_views("""
SELECT series_id, max(train_max) AS train_max,
       round(avg(CASE WHEN target > train_max THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_above_train_max
FROM (SELECT *, max(CASE WHEN rn > 12 THEN target END) OVER (PARTITION BY series_id) AS train_max
      FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rn
            FROM rev_panel))
WHERE rn <= 12 GROUP BY 1""", "rev_panel"))
def ag8(spark, sf):
    d = wn.time_split(panels.rev_panel(spark, sf), 12, check=False)
    a = ag.share_above_train_max(d)
    return a.select("series_id", "train_max", r("pct_above_train_max", 6))


# --------------------------------------------------------------- sorts
@register("so1_sort", with_views("SELECT series_id, period, target FROM rev_panel ORDER BY 1, 2",
                                 "rev_panel"))
def so1(spark, sf):
    return panels.rev_panel(spark, sf).select("series_id", "period", "target").orderBy(
        "series_id", "period")


@register("so2_worst_periods", with_views("""
SELECT series_id, period, target_kind, round(actual, 2) AS actual, round(predicted, 2) AS predicted,
       round(abs(predicted - actual) / actual * 100, 6) AS abs_pct_error
FROM zero_fc WHERE actual <> 0 ORDER BY abs_pct_error DESC NULLS LAST""", "zero_fc"))
def so2(spark, sf):
    e = mt.period_errors(zero_fc(spark, sf).filter(F.col("actual") != 0))
    return e.select("series_id", "period", "target_kind", r("actual", 2), r("predicted", 2),
                    r("abs_pct_error", 6))


@register("so3_head_tail", with_views("""
SELECT series_id, period, target, 'head' AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS rn FROM rev_panel) WHERE rn <= 3
UNION ALL
SELECT series_id, period, target, 'tail' AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rn FROM rev_panel) WHERE rn <= 3""",
                                      "rev_panel"))
def so3(spark, sf):
    from mensura.operators.sort import head, tail
    p = panels.rev_panel(spark, sf).select("series_id", "period", "target")
    return (head(p, 3).withColumn("part", F.lit("head"))
            .unionByName(tail(p, 3).withColumn("part", F.lit("tail"))))


@register("so5_time_split", with_views("""
SELECT series_id, period, CASE WHEN count(*) OVER (PARTITION BY series_id) <= 12 THEN 'error'
       WHEN row_number() OVER (PARTITION BY series_id ORDER BY period DESC) <= 12 THEN 'test'
       ELSE 'train' END AS split
FROM rev_panel""", "rev_panel"))
def so5(spark, sf):
    return wn.time_split(panels.rev_panel(spark, sf), 12).select("series_id", "period", "split")



# --------------------------------------------------------------- streaming
@register("ag6_resample_stream", _AG6_SQL)
def ag6_stream(spark, sf):
    """AG6 as a Structured Streaming job: the shifted events land as parquet
    files, a file-source stream folds them a few files per micro-batch into
    running monthly means, and the landed batches are read back latest-wins
    on the month spine."""
    from mensura.session import scratch_dir
    from mensura.streaming.resample import read_monthly_mean, run_monthly_mean_stream
    base = scratch_dir(spark, "ag6stream")
    shifted_events(spark, sf).write.parquet(f"{base}/src")
    run_monthly_mean_stream(spark, f"{base}/src", "series_id string, ts timestamp_ntz, value double", "ts",
                            "value", f"{base}/out", f"{base}/ckpt", files_per_batch=8)
    return read_monthly_mean(spark, f"{base}/out").select("series_id", "period", r("value", 6))


@register("ag6_resample_stream_watermark", _AG6_SQL)
def ag6_stream_wm(spark, sf):
    """The streaming resample with bounded state: a watermark of 31 days on
    the month key evicts finished months. The shifted events land in four
    time ranges, oldest first, each as many files as it has partitions; the
    stream is resumed from its checkpoint after each landing and takes it as
    one micro-batch, so no row arrives after its month was evicted and the
    result equals the batch resample."""
    from mensura.session import scratch_dir
    from mensura.streaming.resample import read_monthly_mean, run_monthly_mean_stream
    base = scratch_dir(spark, "ag6wm")
    # months as numbers: Python's dates end with the year 9999, Spark's do not
    ev = shifted_events(spark, sf).withColumn("_m", F.year("ts") * 12 + F.month("ts"))
    lo, hi = ev.agg(F.min("_m"), F.max("_m")).first()
    step = -(-(hi - lo + 1) // 4)
    for i in range(4):  # one landing per time range, oldest first
        part = ev.filter((F.col("_m") >= lo + i * step) & (F.col("_m") < lo + (i + 1) * step)).drop("_m")
        part.write.parquet(f"{base}/src/part{i}")
        run_monthly_mean_stream(spark, f"{base}/src/*", "series_id string, ts timestamp_ntz, value double", "ts",
                                "value", f"{base}/out", f"{base}/ckpt", late_delay="31 days")
    return read_monthly_mean(spark, f"{base}/out").select("series_id", "period", r("value", 6))
