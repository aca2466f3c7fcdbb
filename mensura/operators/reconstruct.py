"""Level reconstruction (ML11) and the zero-change benchmark forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.windows import expanding_trend

TARGET_KINDS = ["mom_logdiff", "yoy_logdiff", "trend_dev"]


def anchor_for(kind: Column, trend_col: str = "trend_next") -> Column:
    """Log-level anchor for a de-levelled target kind; null for unknown kinds."""
    return (F.when(kind == "mom_logdiff", F.col("log_lag1"))
            .when(kind == "yoy_logdiff", F.col("log_lag12"))
            .when(kind == "trend_dev", F.col(trend_col)))


def reconstruct(df: DataFrame, kind: str = "target_kind", pred: str = "pred_target",
                trend_col: str = "trend_next", name: str = "predicted") -> DataFrame:
    """ML11: ``exp(anchor + pred)``; rows of an unknown kind get
    ``error='unknown target kind'`` and a null level instead of failing."""
    k = F.col(kind)
    known = k.isin(*TARGET_KINDS)
    return df.withColumns({
        name: F.exp(anchor_for(k, trend_col) + F.col(pred)),
        "error": F.when(~known, F.concat(F.lit("unknown target kind: "), k)),
    })


def zero_change_forecasts(targets: DataFrame, n_test: int = 12,
                          keys: Sequence[str] = ("series_id",), order: str = "period",
                          kinds: Sequence[str] = tuple(TARGET_KINDS)) -> DataFrame:
    """Benchmark forecasts for the last ``n_test`` periods of each series:
    predicted de-levelled change 0, i.e. last month (MoM), same month last
    year (YoY) or the expanding trend (trend) as the level forecast.

    ``targets`` is the output of ``build_targets`` (t, log_y, log_lag1,
    log_lag12). Returns (keys, period, target_kind, actual, predicted).
    """
    from pyspark.sql import Window

    w_desc = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    d = targets.withColumns({
        "trend_next": expanding_trend("log_y", "t", keys, order),
        "_rn": F.row_number().over(w_desc),
    }).filter(F.col("_rn") <= n_test)
    d = d.withColumn("target_kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    d = d.withColumn("pred_target", F.lit(0.0))
    d = reconstruct(d)
    return d.select(*keys, order, "target_kind", F.col("target").alias("actual"), "predicted")
