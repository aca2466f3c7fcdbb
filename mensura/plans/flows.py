"""Composite data flows (FW5, FW6 and the helpers the FW queries share).

Every flow is one lazy DAG; all window features share the spec
``partitionBy(series_id).orderBy(period)`` so a flow costs one exchange for
its window block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.clean import cyclic_cos, cyclic_sin
from mensura.operators import windows as wn
from mensura.operators.reshape import month_dummies

LEVEL_LAGS = (1, 2, 3, 12, 13)


def delevel_dataset(panel: DataFrame, covariates: Sequence[str], target: str = "target",
                    keys: Sequence[str] = ("series_id",), order: str = "period",
                    trend: str = "expanding") -> DataFrame:
    """FW6: time index, log target, month dummies m_2..m_12, 1- and 12-step
    covariate changes, and the three de-levelled targets (``trend`` as in
    ``build_targets``)."""
    d = wn.build_targets(panel, target, keys, order, trend=trend)
    d = month_dummies(d, order)
    return wn.add_diffs(d, covariates, (1, 12), keys, order)


def level_features(panel: DataFrame, covariates: Sequence[str], target: str = "target",
                   keys: Sequence[str] = ("series_id",), order: str = "period",
                   optional: Mapping[str, Sequence[str]] | None = None):
    """FW5: calendar parts, cyclic month, target lags 1/2/3/12/13, trailing
    3/12 means (current row excluded), prior-known YoY growth; rows with any
    missing feature dropped (FL2). Returns (frame, feature names).

    ``optional`` adds the local block (WN6), given as the groups of
    ``windows.local_features``. A series that has no value of a covariate at
    all keeps its rows: the features made of it are 0 throughout, which a
    ridge and a tree leave out (a constant has no spread to scale and no
    split), so the series solves its smaller system in the same batch. Their
    names are in the column ``absent``. A series that has the covariate loses
    the rows of its warm-up as for any other feature."""
    m = F.month(order)
    d = panel.withColumns({"month": m, "quarter": F.quarter(order),
                           "month_sin": cyclic_sin(m), "month_cos": cyclic_cos(m)})
    d = wn.add_lags(d, target, LEVEL_LAGS, keys, order)
    d = wn.add_trailing_mean(d, target, (3, 12), keys, order)
    d = wn.add_prev_yoy(d, target, keys, order)
    feats = (list(covariates) + ["month", "quarter", "month_sin", "month_cos"]
             + [f"{target}_lag{k}" for k in (1, 2, 3, 12)]
             + [f"{target}_roll3_mean", f"{target}_roll12_mean", f"{target}_prev_yoy_pct"])
    if optional:
        made = wn.local_features(panel.columns, keys, order, **optional)
        has = {s: F.max(F.col(s).isNotNull()).over(Window.partitionBy(*keys)) for s, _ in made.values()}
        d = d.withColumns({f: F.when(has[s], col.cast("double")).otherwise(F.lit(0.0))
                           for f, (s, col) in made.items()}
                          | {"absent": F.array_compact(F.array(*[F.when(~has[s], F.lit(f))
                                                                 for f, (s, _) in made.items()]))
                             .cast("array<string>")})
        feats += list(made)
    d = d.na.drop("any", subset=feats + [target])
    return d, feats


def warmup_report(panel: DataFrame, featured: DataFrame, keys: Sequence[str] = ("series_id",),
                  order: str = "period") -> DataFrame:
    """Rows per series before and after the feature warm-up drop, the real
    number dropped, and the first usable period (Q6: a 13-month lag drops 13
    rows, not 12)."""
    keys = list(keys)
    before = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    after = featured.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"),
                                        F.min(order).alias("first_usable"))
    out = before.join(after, keys, "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return out.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
