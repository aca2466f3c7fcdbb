"""Window operators over a panel (WN1-WN10, JN4, SO5).

All functions share one window spec ``partitionBy(keys).orderBy(order)``;
Catalyst evaluates window expressions with the same spec in one Window
operator after a single ``hashpartitioning(keys)`` exchange, so chaining
these functions costs one shuffle, not one per feature. A window group is
one series: at most one row per (series, period), so a group's size is
bounded by the number of periods, not by the data volume.

Lags are positional by default (row ``i-k`` after ordering, as in the
reference). ``calendar=True`` makes them gap-aware: the value exactly ``k``
months earlier via a ``rangeBetween(-k, -k)`` frame on a month index.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.clean import log_target

DEFAULT_KEYS = ("series_id",)


def series_window(keys: Sequence[str] = DEFAULT_KEYS, order: str = "period"):
    return Window.partitionBy(*keys).orderBy(order)


def _month_index(order: str) -> Column:
    return F.year(order) * 12 + F.month(order)


def lag_col(col: str, k: int, keys=DEFAULT_KEYS, order="period", calendar=False) -> Column:
    if calendar:
        w = Window.partitionBy(*keys).orderBy(_month_index(order)).rangeBetween(-k, -k)
        return F.first(col).over(w)
    return F.lag(col, k).over(series_window(keys, order))


def add_time_index(df: DataFrame, keys=DEFAULT_KEYS, order="period", name="t") -> DataFrame:
    """WN7: 0-based row position per series, ordered by period."""
    return df.withColumn(name, F.row_number().over(series_window(keys, order)) - 1)


def add_lags(df: DataFrame, col: str, ks: Iterable[int] = (1, 2, 3, 12, 13),
             keys=DEFAULT_KEYS, order="period", calendar=False) -> DataFrame:
    """WN1: ``{col}_lag{k}`` for each k."""
    return df.withColumns({f"{col}_lag{k}": lag_col(col, k, keys, order, calendar) for k in ks})


def trailing_mean(col: str, w: int, keys=DEFAULT_KEYS, order="period") -> Column:
    """Mean of the ``w`` rows before the current one; null unless all ``w`` are present."""
    frame = series_window(keys, order).rowsBetween(-w, -1)
    return F.when(F.count(col).over(frame) == w, F.avg(col).over(frame))


def add_trailing_mean(df: DataFrame, col: str, ws: Iterable[int] = (3, 12),
                      keys=DEFAULT_KEYS, order="period") -> DataFrame:
    """WN2: ``{col}_roll{w}_mean`` excluding the current row, full window required."""
    return df.withColumns({f"{col}_roll{w}_mean": trailing_mean(col, w, keys, order) for w in ws})


def add_diffs(df: DataFrame, cols: Iterable[str], ks: Iterable[int] = (1, 12),
              keys=DEFAULT_KEYS, order="period", calendar=False) -> DataFrame:
    """WN3: ``{c}_chg{k} = c - lag(c, k)``."""
    out = {}
    for c in cols:
        for k in ks:
            out[f"{c}_chg{k}"] = F.col(c) - lag_col(c, k, keys, order, calendar)
    return df.withColumns(out)


def add_prev_yoy(df: DataFrame, col: str, keys=DEFAULT_KEYS, order="period") -> DataFrame:
    """WN4: prior-known YoY growth ``(lag1 - lag13) / lag13``."""
    l1 = lag_col(col, 1, keys, order)
    l13 = lag_col(col, 13, keys, order)
    return df.withColumn(f"{col}_prev_yoy_pct", F.try_divide(l1 - l13, l13))  # null for a 0 base


def add_yoy_pct(df: DataFrame, col: str, keys=DEFAULT_KEYS, order="period") -> DataFrame:
    """WN5: current-row ``pct_change(12)``. Uses the current target, so it
    leaks when used as a feature for that target; never in default features."""
    return df.withColumn(f"{col}_yoy_pct", F.try_divide(F.col(col), lag_col(col, 12, keys, order)) - 1)


def local_features(columns: Sequence[str], keys=DEFAULT_KEYS, order="period",
                   ridership: Sequence[str] = (), shops: Sequence[str] = (), net_new: Sequence[str] = (),
                   sentiment: Sequence[str] = ()) -> dict[str, tuple[str, Column]]:
    """WN6: features of the optional covariates among ``columns``, each with
    the covariate it is made of.

    ridership: lag1, lag12, ``(lag1 - lag12)/(lag12 + 1e-9)``; shop count and
    net-new: lag1; sentiment: lag1 and trailing-3 mean. Each group takes the
    first of its names present in the frame; a group without names is left out.
    """
    def first_present(names):
        return next((n for n in names if n in columns), None)

    out = {}
    r = first_present(ridership)
    if r:
        l1, l12 = lag_col(r, 1, keys, order), lag_col(r, 12, keys, order)
        out.update({"ridership_lag1": (r, l1), "ridership_lag12": (r, l12),
                    "ridership_yoy": (r, F.try_divide(l1 - l12, l12 + F.lit(1e-9)))})
    s = first_present(shops)
    if s:
        out["shop_count_lag1"] = (s, lag_col(s, 1, keys, order))
    nn = first_present(net_new)
    if nn:
        out["net_new_lag1"] = (nn, lag_col(nn, 1, keys, order))
    se = first_present(sentiment)
    if se:
        out["sentiment_lag1"] = (se, lag_col(se, 1, keys, order))
        out["sentiment_roll3"] = (se, trailing_mean(se, 3, keys, order))
    return out


def add_local_features(df: DataFrame, keys=DEFAULT_KEYS, order="period", **groups: Sequence[str]) -> DataFrame:
    """WN6: the optional covariate block (``local_features``) as columns."""
    out = {name: col for name, (_, col) in local_features(df.columns, keys, order, **groups).items()}
    return df.withColumns(out) if out else df


def add_trend_dev(df: DataFrame, y: str = "log_y", t: str = "t", keys=DEFAULT_KEYS,
                  name: str = "trend_dev") -> DataFrame:
    """WN8: full-sample least-squares trend of ``y`` on ``t`` per series and
    the deviation from it (``regr_slope``/``regr_intercept`` over the whole
    partition; no row order needed)."""
    w = Window.partitionBy(*keys)
    trend = F.regr_intercept(y, t).over(w) + F.regr_slope(y, t).over(w) * F.col(t)
    return df.withColumns({"trend_full": trend, name: F.col(y) - trend})


def expanding_trend(y: str = "log_y", t: str = "t", keys=DEFAULT_KEYS,
                    order: str = "period", min_t: int | None = None) -> Column:
    """WN9: trend fitted on strictly earlier rows, evaluated at this row's t.

    ``min_t`` restricts the fit to rows with ``t >= min_t`` (the reference's
    fold trend skips the first row, lost to the 1-step differences).
    """
    frame = series_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    yy = F.col(y) if min_t is None else F.when(F.col(t) >= min_t, F.col(y))
    return F.regr_intercept(yy, t).over(frame) + F.regr_slope(yy, t).over(frame) * F.col(t)


def add_expanding_trend(df: DataFrame, y="log_y", t="t", keys=DEFAULT_KEYS, order="period",
                        name="trend_next", min_t=None) -> DataFrame:
    return df.withColumn(name, expanding_trend(y, t, keys, order, min_t))


def build_targets(df: DataFrame, target: str = "target", keys=DEFAULT_KEYS,
                  order: str = "period", calendar: bool = False, trend: str = "expanding") -> DataFrame:
    """WN10 (+WN7, SC11): ``t``, ``log_y``, ``mom_logdiff``, ``yoy_logdiff``,
    ``trend_dev``, plus the anchors ``log_lag1``/``log_lag12`` used for level
    reconstruction (JN4).

    ``trend='expanding'`` measures ``trend_dev`` against the trend fitted on
    strictly earlier rows, the same trend the reconstruction adds back, so
    no label looks ahead; ``trend='full'`` uses the full-sample trend (parity
    with the published runs, but the label of an early row then depends on
    later rows).
    """
    w = series_window(keys, order)
    out = df.withColumns({"t": F.row_number().over(w) - 1, "log_y": log_target(target)})
    out = out.withColumns({
        "log_lag1": lag_col("log_y", 1, keys, order, calendar),
        "log_lag12": lag_col("log_y", 12, keys, order, calendar),
    })
    out = out.withColumns({
        "mom_logdiff": F.col("log_y") - F.col("log_lag1"),
        "yoy_logdiff": F.col("log_y") - F.col("log_lag12"),
    })
    if trend == "expanding":
        nxt = expanding_trend("log_y", "t", keys, order)
        return out.withColumns({"trend_full": nxt, "trend_dev": F.col("log_y") - nxt})
    if trend != "full":
        raise ValueError(f"trend must be 'full' or 'expanding', not {trend!r}")
    return add_trend_dev(out, "log_y", "t", keys)


def anchor(df: DataFrame, col: str, k: int, keys=DEFAULT_KEYS, order="period",
           name: str | None = None) -> DataFrame:
    """JN4: value of ``col`` at row i-k (positional anchor for reconstruction)."""
    return df.withColumn(name or f"{col}_anchor{k}", lag_col(col, k, keys, order))


def time_split(df: DataFrame, n_test: int, keys=DEFAULT_KEYS, order="period",
               check: bool = True) -> DataFrame:
    """SO5: mark the last ``n_test`` rows of each series as ``split='test'``.

    With ``check=True`` the column ``split`` is ``'error'`` for every row of a
    series whose length is not larger than ``n_test`` (reference: raise);
    callers filter or assert on it without a driver round trip per series.
    """
    w_desc = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w_desc)
    split = F.when(rn <= n_test, F.lit("test")).otherwise(F.lit("train"))
    if check:
        split = F.when(n <= n_test, F.lit("error")).otherwise(split)
    return df.withColumn("split", split)
