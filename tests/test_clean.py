"""Cleaning scalars on hand-written dirty text (SC1-SC8, quirks Q1, Q10)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mensura.functions import clean as C

D = dt.date


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_parse_money(spark):
    df = one_col(spark, ["1,234.5", '"24,966,333.31"', "nan", "", "abc", None, "  7 "])
    got = [r[0] for r in df.select(C.parse_money("v")).collect()]
    assert got == [1234.5, 24966333.31, None, None, None, None, 7.0]


def test_parse_percent(spark):
    df = one_col(spark, ["5.70%", "4%", "x%", None])
    got = [r[0] for r in df.select(C.parse_percent("v")).collect()]
    assert got == [5.7, 4.0, None, None]
    num = spark.createDataFrame([(5.7,)], "v double")
    assert num.select(C.parse_percent("v", is_numeric=True)).first()[0] == 5.7


def test_parse_date_formats_and_pivot(spark):
    # Q1: every format is tried on the raw string; Q10: yy >= 69 -> 19yy
    df = one_col(spark, ["1/1/15", "2015-01-01", "1/1/15 0:00", "1/1/69", "1/1/68", "12/31/99", "junk"])
    got = [r[0] for r in df.select(C.parse_date("v")).collect()]
    assert got == [D(2015, 1, 1), D(2015, 1, 1), D(2015, 1, 1), D(1969, 1, 1), D(2068, 1, 1),
                   D(1999, 12, 31), None]


def test_parse_date_custom_pivot(spark):
    df = one_col(spark, ["1/1/50"])
    assert df.select(C.parse_date("v", two_digit_pivot=40)).first()[0] == D(1950, 1, 1)
    assert df.select(C.parse_date("v", two_digit_pivot=69)).first()[0] == D(2050, 1, 1)


def test_strict_date_raises_on_mismatch(spark):
    df = one_col(spark, ["2015-01-01"])
    with pytest.raises(Exception):
        df.select(C.parse_date("v", ["M/d/yy"], strict=True)).collect()


def test_month_start_and_calendar(spark):
    df = spark.createDataFrame([(2015, "Mar"), (2020, "Dec")], "y int, m string")
    got = [r[0] for r in df.select(C.month_start("y", "m")).collect()]
    assert got == [D(2015, 3, 1), D(2020, 12, 1)]


def test_log_guard_and_pct_effect(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "v double")
    assert [r[0] for r in df.select(C.log_target("v")).collect()] == [None, None, 0.0]
    e = spark.createDataFrame([(0.0,)], "b double").select(C.pct_effect("b")).first()[0]
    assert e == 0.0


def test_abs_pct_error_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (100.0, 110.0)], "a double, p double")
    got = [r[0] for r in df.select(C.abs_pct_error("p", "a")).collect()]
    assert got[0] is None and got[1] == pytest.approx(10.0)


def test_threshold_label(spark):
    df = spark.createDataFrame([(0.95, 3.0, 1e6), (0.95, 3.0, 9e6)], "r2 double, mape double, rmse double")
    got = [r[0] for r in df.select(C.threshold_label("r2", "mape", "rmse")).collect()]
    assert got == ["PASS", "fail"]
    per_series = df.withColumn("bar", F.lit(1e7))
    got = [r[0] for r in per_series.select(C.threshold_label("r2", "mape", "rmse", rmse_max=F.col("bar"))).collect()]
    assert got == ["PASS", "PASS"]


def test_month_start_unknown_name_is_null(spark):
    df = spark.createDataFrame([(2015, "Foo"), (2015, "Jan")], "y int, m string")
    assert [r[0] for r in df.select(C.month_start("y", "m")).collect()] == [None, D(2015, 1, 1)]
