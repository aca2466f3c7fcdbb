"""Window operators, spine and densify on hand-written series (WN, RS5, JN3,
SO5, quirks Q5, Q8)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import reshape as rs
from mensura.operators import windows as wn
from mensura.plans.panels import densify


def months(start_year, n, skip=()):
    out, y, m = [], start_year, 1
    for i in range(n):
        if i not in skip:
            out.append(dt.date(y, m, 1))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


@pytest.fixture
def two_series(spark):
    """A: 30 months, month index 14 missing; B: 30 months, one duplicate month."""
    rows = [("A", d, float(100 + i)) for i, d in enumerate(months(2015, 30, skip={14}))]
    bm = months(2015, 30)
    rows += [("B", d, float(200 + i)) for i, d in enumerate(bm)]
    rows.append(("B", bm[5], 999.0))
    return spark.createDataFrame(rows, "series_id string, period date, target double")


def test_positional_vs_calendar_lag(spark, two_series):
    a = two_series.filter("series_id = 'A'")
    pos = {r.period: r.target_lag12 for r in wn.add_lags(a, "target", [12]).collect()}
    cal = {r.period: r.target_lag12 for r in wn.add_lags(a, "target", [12], calendar=True).collect()}
    p = dt.date(2016, 5, 1)  # 16th month; its calendar lag is 2015-05 (value 104)
    assert cal[p] == 104.0
    assert pos[p] != cal[p]  # Q5: the gap shifts the positional lag
    assert dt.date(2016, 3, 1) not in cal  # the missing month has no row
    assert cal[dt.date(2016, 4, 1)] == 103.0 and pos[dt.date(2016, 4, 1)] == 102.0


def test_trailing_mean_needs_full_window(spark, two_series):
    a = two_series.filter("series_id = 'A'").orderBy("period")
    rows = wn.add_trailing_mean(a, "target", [3]).orderBy("period").collect()
    assert [r.target_roll3_mean for r in rows[:3]] == [None, None, None]
    assert rows[3].target_roll3_mean == pytest.approx((100 + 101 + 102) / 3)


def test_expanding_trend_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    y = np.log(1000 + np.cumsum(rng.uniform(1, 5, 20)))
    df = spark.createDataFrame([("s", dt.date(2000 + i // 12, i % 12 + 1, 1), float(i), float(v))
                                for i, v in enumerate(y)], "series_id string, period date, t double, log_y double")
    got = {int(r.t): r.trend_next for r in wn.add_expanding_trend(df).collect()}
    for i in (5, 12, 19):
        b, a = np.polyfit(np.arange(i), y[:i], 1)
        assert got[i] == pytest.approx(a + b * i, rel=1e-10)


def test_time_split_guard(spark):
    short = spark.createDataFrame([("s", d, 1.0) for d in months(2020, 5)], "series_id string, period date, target double")
    assert {r.split for r in wn.time_split(short, 12).collect()} == {"error"}
    long = spark.createDataFrame([("s", d, 1.0) for d in months(2020, 20)], "series_id string, period date, target double")
    counts = {r.split: r["count"] for r in wn.time_split(long, 12).groupBy("split").count().collect()}
    assert counts == {"train": 8, "test": 12}


def test_short_series_lag12_empty_after_drop(spark):
    short = spark.createDataFrame([("s", d, 1.0) for d in months(2020, 5)], "series_id string, period date, target double")
    d = wn.add_lags(short, "target", [12]).na.drop(subset=["target_lag12"])
    assert d.count() == 0


def test_month_dummies_fixed_baseline(spark):
    # Q8: even without January rows, m_2..m_12 are the columns
    df = spark.createDataFrame([("s", dt.date(2020, m, 1)) for m in (2, 3)], "series_id string, period date")
    out = rs.month_dummies(df)
    assert [c for c in out.columns if c.startswith("m_")] == [f"m_{k}" for k in range(2, 13)]
    r = out.filter("period = '2020-02-01'").first()
    assert r.m_2 == 1 and r.m_3 == 0


def test_densify_ffill_and_zero(spark, two_series):
    a = two_series.filter("series_id = 'A'")
    ff = densify(a, ["target"]).orderBy("period").collect()
    assert len(ff) == 30
    gap = [r for r in ff if r.imputed]
    assert len(gap) == 1 and gap[0].period == dt.date(2016, 3, 1) and gap[0].target == 113.0
    z = densify(a, ["target"], policy="zero").filter("imputed").first()
    assert z.target == 0.0


def test_missing_periods_and_spine(spark, two_series):
    a = two_series.filter("series_id = 'A'")
    miss = [r.period for r in rs.missing_periods(a).collect()]
    assert miss == [dt.date(2016, 3, 1)]
    sp = rs.month_spine_of(a, start="2016-01-01")
    assert sp.agg(F.min("period")).first()[0] == dt.date(2016, 1, 1)


def test_duplicates_found_on_long_table(spark, two_series):
    from mensura.operators.aggregate import duplicate_periods
    d = duplicate_periods(two_series).collect()
    assert len(d) == 2 and {r.n_copies for r in d} == {2} and {r.series_id for r in d} == {"B"}


def test_build_targets(spark):
    vals = [100.0 * (1.01 ** i) for i in range(30)]
    df = spark.createDataFrame([("s", d, v) for d, v in zip(months(2015, 30), vals)],
                               "series_id string, period date, target double")
    t = wn.build_targets(df).orderBy("period").collect()
    assert t[1].mom_logdiff == pytest.approx(np.log(1.01))
    assert t[12].yoy_logdiff == pytest.approx(12 * np.log(1.01))
    assert abs(t[20].trend_dev) < 1e-9  # exact exponential growth: no deviation


def test_expanding_trend_labels_do_not_look_ahead(spark):
    vals = [100.0 * (1.01 ** i) for i in range(30)]
    df = spark.createDataFrame([("s", d, v) for d, v in zip(months(2015, 30), vals)],
                               "series_id string, period date, target double")
    changed = df.withColumn("target", F.when(F.col("period") >= "2016-06-01", F.col("target") * 2)
                            .otherwise(F.col("target")))
    a = {r.period: r.trend_dev for r in wn.build_targets(df).collect()}
    b = {r.period: r.trend_dev for r in wn.build_targets(changed).collect()}
    early = [p for p in a if p < dt.date(2016, 6, 1)]
    assert all(a[p] == b[p] for p in early)
    full_a = {r.period: r.trend_dev for r in wn.build_targets(df, trend="full").collect()}
    full_b = {r.period: r.trend_dev for r in wn.build_targets(changed, trend="full").collect()}
    assert any(full_a[p] != full_b[p] for p in early)  # Q3: the full-sample label looks ahead


def test_zero_and_negative_targets_do_not_fail(spark):
    """zero_neg fixture: targets 0 and -1 give null logs / ratios, not errors
    (ANSI mode raises on a plain division by zero)."""
    from mensura.operators import metrics as mt
    vals = [5.0, 0.0, -1.0] + [float(i + 1) for i in range(14)]
    df = spark.createDataFrame([("s", d, v) for d, v in zip(months(2015, len(vals)), vals)],
                               "series_id string, period date, target double")
    t = wn.build_targets(df).orderBy("period").collect()
    assert t[1].log_y is None and t[2].log_y is None and t[1].mom_logdiff is None
    y = wn.add_yoy_pct(wn.add_prev_yoy(df, "target"), "target").orderBy("period").collect()
    assert y[13].target_yoy_pct is None          # base 12 months earlier is 0
    assert y[14].target_prev_yoy_pct is None      # lag13 is 0
    m = mt.forecast_metrics(df.select("series_id", F.col("target").alias("actual"),
                                      (F.col("target") + 1).alias("predicted"))).first()
    assert m.MAPE_pct is not None and m.RMSE == 1.0


def test_line_amounts_equal_their_decimal_casts(spark):
    """Hundredths are the decimal casts' also for doubles that no number of
    hundredths is nearest to, and are mostly had without the cast."""
    from pyspark.sql import functions as F

    from mensura.plans import panels
    values = [0.0, 0.01, 0.07, 1.005, 2.675, -1.005, 12345.67, 104949.5, 9999999999.99, 0.29, 1.1 + 2.2, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = (F.col("v").cast("decimal(12,2)") * 100).cast("bigint")
    rows = df.select("v", panels._hundredths("v", "decimal(12,2)", 10**12).alias("got"), want.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and rows[3].got == 101
    lines = spark.createDataFrame([(10.05, 0.06), (99.99, 0.1), (1.005, 0.005)], "l_extendedprice double, l_discount double")
    price, disc = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    r = lines.agg(panels._revenue(F.sum(panels._line_revenue())).alias("got"),
                  F.sum(price * (F.lit(1).cast("decimal(1,0)") - disc)).alias("want")).first()
    assert r.got == r.want
