"""Reshape and join operators against brute force on small fixtures."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from mensura.functions.clean import MONTH_ABBR
from mensura.operators import reshape as rs


def test_unpivot_of_pivot_is_identity(spark):
    rng = np.random.default_rng(11)
    rows = [("s" + str(s), y, MONTH_ABBR[m], float(rng.integers(1, 1000)))
            for s in range(3) for y in (2019, 2020) for m in range(12) if rng.random() > 0.2]
    long = spark.createDataFrame(rows, "series_id string, Year int, Month string, Value double")
    wide = rs.long_to_wide(long, ["series_id", "Year"], "Month", "Value", MONTH_ABBR)
    back = rs.wide_to_long(wide, ["series_id", "Year"]).filter(F.col("Value").isNotNull())
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_snapshot_counts_equal_theta_join(spark):
    rng = np.random.default_rng(12)
    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(36)]
    objs = []
    for i in range(200):
        a = int(rng.integers(0, 36))
        b = int(rng.integers(a, 36))
        objs.append((i, months[a], months[b]))
    df = spark.createDataFrame(objs, "obj_id int, first_seen date, last_seen date")
    got = {r.period: r.alive for r in rs.snapshot_counts(df).collect()}
    lo, hi = min(o[1] for o in objs), max(o[2] for o in objs)
    for m in months:
        if lo <= m <= hi:
            assert got[m] == sum(1 for _, a, b in objs if a <= m <= b)
    assert len(got) == sum(1 for m in months if lo <= m <= hi)


def test_fold_layout_join_matches_brute_force(spark):
    rows = [("s", t) for t in range(10)]
    df = spark.createDataFrame(rows, "series_id string, t int")
    folds = spark.createDataFrame([("s", 3), ("s", 7)], "series_id string, fold_t int")
    got = sorted((r.fold_t, r.t) for r in rs.fold_layout_join(df, folds).collect())
    assert got == sorted((f, t) for f in (3, 7) for t in range(10) if t < f)


def test_join_covariates_left_and_pruned(spark):
    base = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("a", dt.date(2020, 2, 1))],
                                 "series_id string, period date")
    covs = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0, 9.0)], "period date, c1 double, unused double")
    out = rs.join_covariates(base, covs, ["period"], ["c1"])
    assert out.columns == ["period", "series_id", "c1"]
    assert sorted((r.period, r.c1) for r in out.collect()) == [(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 2, 1), None)]


def test_snapshot_open_ends_and_any_day(spark):
    import datetime as dt
    from mensura.operators.geo import density_series
    from mensura.operators.reshape import merged_lifetimes, snapshot_counts
    d = lambda m, day=1: dt.date(2020, m, day)
    rows = [(1, d(1), None), (2, d(2), d(3)), (3, d(2), None), (4, d(3, 5), d(4)), (5, d(1), d(1, 15)), (6, None, d(2)),
            (7, d(4), d(2)), (8, d(2, 3), d(2, 20))]
    schema = "obj_id int, first_seen date, last_seen date"
    objs = spark.createDataFrame(rows, schema)
    assert [(r.period.month, r.alive) for r in snapshot_counts(objs).orderBy("period").collect()] == [(1, 2), (2, 3), (3, 3), (4, 3)]
    days = spark.createDataFrame([(d(1, 15),), (d(1, 16),), (d(2, 20),), (dt.date(2019, 1, 1),), (dt.date(2031, 1, 1),)], "period date")
    got = {r.period: r.alive for r in snapshot_counts(objs, spine=days).collect()}
    assert got == {d(1, 15): 2, d(1, 16): 1, d(2, 20): 4, dt.date(2019, 1, 1): 0, dt.date(2031, 1, 1): 2}
    versions = spark.createDataFrame([(1, d(1), d(1, 10)), (1, d(1, 11), d(2)), (1, d(1, 5), d(1, 6)), (1, d(4), None), (1, d(5), d(6)),
                                      (2, d(3), d(3))], schema)
    got = sorted((r.obj_id, r.first_seen, r.last_seen) for r in merged_lifetimes(versions, "obj_id").collect())
    assert got == [(1, d(1), d(2)), (1, d(4), None), (2, d(3), d(3))]
    assert snapshot_counts(objs.limit(0)).collect() == []
    places = objs.selectExpr("*", "1.0D AS lon", "1.0D AS lat", "map('shop', 'x') AS tags",
                             "element_at(array('node', 'way', 'relation'), 1 + obj_id % 3) AS osm_type")
    assert [r.shop_count for r in density_series(places, (0, 0, 2, 2)).orderBy("period").collect()] == [2, 3, 3, 3]
