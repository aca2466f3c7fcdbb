"""Forecast metrics, ranking and selection (AG9-AG12, SC12, SC13, SO2, SO4,
ML14, ML15, ML19).

Metrics are one ``groupBy(keys).agg`` with partial (map-side) aggregation:
sums of squared / absolute errors and a population variance, so a series
with a third of all rows still aggregates in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.clean import abs_pct_error, threshold_label

METRIC_NAMES_A = ["R2", "MAE", "RMSE", "MAPE_pct", "sMAPE_pct"]
METRIC_NAMES_B = ["R2", "MAPE_pct", "RMSE"]


def forecast_metrics(df: DataFrame, actual: str = "actual", pred: str = "predicted",
                     keys: Sequence[str] = ("series_id",), which: str = "A") -> DataFrame:
    """AG9 (``which='A'``: R2, MAE, RMSE, MAPE %, sMAPE %) or AG10 (``'B'``:
    R2, MAPE %, RMSE) per group.

    Rows with a null actual or prediction are not scored. If ``df`` has an
    ``error`` column, a group that has nothing to score but an error comes
    back with ``n`` 0, null metrics and its ``error``. MAPE skips rows
    with actual 0 (null if all are 0); R2 is null for a constant actual.
    sMAPE adds 1e-9 to its denominator.
    """
    errors = "error" in df.columns
    scored = F.col(actual).isNotNull() & F.col(pred).isNotNull()
    # with errors, rows that are not scored stay, with nulls that no aggregate counts: ``df`` is read once
    a, p = (F.when(scored, F.col(c)) if errors else F.col(c) for c in (actual, pred))
    err = a - p
    agg = (df if errors else df.filter(scored)).groupBy(*keys).agg(
        F.count(a).alias("n"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(a) * F.count(a)).alias("_sst"),
        F.avg(F.abs(err)).alias("MAE"),
        (F.avg(F.when(a != 0, F.abs(err) / F.abs(a))) * 100).alias("MAPE_pct"),
        (F.avg(2 * F.abs(p - a) / (F.abs(a) + F.abs(p) + F.lit(1e-9))) * 100).alias("sMAPE_pct"),
        *([F.min("error").alias("error")] if errors else []),
    )
    agg = agg.withColumns({
        "R2": F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")),
        "RMSE": F.sqrt(F.col("_sse") / F.col("n")),
    })
    names = METRIC_NAMES_A if which == "A" else METRIC_NAMES_B
    if not errors:
        return agg.select(*keys, "n", *names)
    return agg.filter("n > 0 OR error IS NOT NULL").select(
        *keys, "n", *names, F.when(F.col("n") == 0, F.col("error")).alias("error"))


def macro_micro_metrics(df: DataFrame, fold: str = "fold", actual="actual", pred="predicted",
                        keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """AG11: macro (mean of per-fold metrics) next to micro (pooled) metrics."""
    per_fold = forecast_metrics(df, actual, pred, [*keys, fold], "A")
    macro = per_fold.groupBy(*keys).agg(*[F.avg(m).alias(f"macro_{m}") for m in METRIC_NAMES_A])
    micro = forecast_metrics(df, actual, pred, keys, "A").select(
        *keys, *[F.col(m).alias(f"micro_{m}") for m in METRIC_NAMES_A])
    return macro.join(micro, list(keys))


def select_best(metrics: DataFrame, by: str, name: str, keys: Sequence[str] = ("series_id",),
                mode: str = "min") -> DataFrame:
    """AG12: arg-min / arg-max of ``by`` per group; ties go to the smaller name."""
    o = F.col(by).asc_nulls_last() if mode == "min" else F.col(by).desc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(o, F.col(name).asc())
    return (metrics.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") == 1).drop("_r"))


def rank_combos(metrics: DataFrame, by: str = "MAPE_pct", name: str = "combo",
                keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """SO4: rank (1 = best) by ``by`` ascending, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), F.col(name).asc())
    return metrics.withColumn("rank", F.row_number().over(w))


def threshold_check(metrics: DataFrame, r2_min=None, mape_max=None, rmse_max=None,
                    r2="R2", mape="MAPE_pct", rmse="RMSE") -> DataFrame:
    """SC13: PASS/fail on the three thresholds. Thresholds may be columns
    (per-series bars) or numbers."""
    return metrics.withColumn("verdict", threshold_label(r2, mape, rmse, r2_min, mape_max, rmse_max))


def period_errors(df: DataFrame, actual="actual", pred="predicted") -> DataFrame:
    """ML14 (+SC12, SO2): absolute percentage error per period, worst first."""
    out = df.withColumn("abs_pct_error", abs_pct_error(pred, actual))
    return out.orderBy(F.col("abs_pct_error").desc_nulls_last())


def steady_state(df: DataFrame, exclude_months: Sequence[str], actual="actual",
                 pred="predicted", order="period", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """ML15: metrics after excluding listed ``yyyy-MM`` months (FL6). Groups
    whose periods are all excluded produce no row."""
    kept = df.filter(~F.date_format(order, "yyyy-MM").isin(list(exclude_months)))
    return forecast_metrics(kept, actual, pred, keys, "A")


def metrics_long(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metrics row -> (keys, metric, value) long form."""
    return metrics.unpivot(list(keys), list(names), "metric", "value")


def metrics_wide(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """RS3: (keys, metric, value) -> one column per metric (fixed pivot list,
    so no extra job to discover the values)."""
    return long.groupBy(*keys).pivot("metric", list(names)).agg(F.first("value"))
