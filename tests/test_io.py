"""Sources, sinks and streaming on small frames (SRC, SNK, FL4, AG6 stream)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from mensura.sources import csv_io, json_io
from mensura.sources.interest import normalize_interest
from mensura.sources import upsert
from mensura.sources.upsert import upsert_periods


def tmp():
    return tempfile.mkdtemp(prefix="mensura-test-")


def write(path, name, text, encoding="utf-8"):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_bom_thousands_and_blank_columns(spark):
    p = write(tmp(), "a.csv", "﻿Year,Jan,FY Total,,\n2015,\"1,234.50\",\"24,966,333.31\",,\n,,,,\n",
              encoding="utf-8")
    raw = spark.read.option("header", True).csv(p)
    assert raw.columns[0] == "Year"  # BOM dropped from the first header
    from mensura.operators.filters import drop_blank_rows, drop_unnamed
    clean = drop_blank_rows(drop_unnamed(raw))
    assert clean.columns == ["Year", "Jan", "FY Total"] and clean.count() == 1
    typed = csv_io.read_series_csv(spark, p, {"Jan": "double", "FY Total": "double"}, thousands=",")
    r = typed.filter(F.col("Year").isNotNull()).first()
    assert r.Jan == 1234.5 and r["FY Total"] == 24966333.31


def test_preamble_skip(spark):
    lines = [f"preamble {i}" for i in range(11)] + ["Year,Jan,Feb", "2015,1.5,2.5", "2016,3.5,"]
    p = write(tmp(), "cpi.csv", "\n".join(lines) + "\n")
    df = csv_io.read_csv_skip(spark, p, 11, "Year int, Jan double, Feb double")
    assert sorted(tuple(r) for r in df.collect()) == [(2015, 1.5, 2.5), (2016, 3.5, None)]


def test_preamble_skip_across_many_blocks(spark):
    lines = [f"preamble line {i}" for i in range(11)] + ["Year,Jan,Feb"]
    lines += [f"{2000 + i},{i}.5,{i}.25" for i in range(200)]
    p = write(tmp(), "big.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many blocks per file
    try:
        df = csv_io.read_csv_skip(spark, p, 11, "Year int, Jan double, Feb double")
        assert spark.read.text(p).rdd.getNumPartitions() > 5
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(2000 + i, i + 0.5, i + 0.25) for i in range(200)]


def test_json_shapes(spark):
    p1 = write(tmp(), "r.json", '{"result":[{"timestamp":"2020-01-01T00:00:00Z","value":1.5}]}\n{"other":1}\n')
    assert [tuple(r) for r in json_io.json_result_rows(spark, p1).collect()] == [("2020-01-01T00:00:00Z", 1.5)]
    p2 = write(tmp(), "t.json",
               '{"timeline":[{"data":[{"date":"2020-01-01","value":2.0}]},{"data":[{"date":"x","value":9.0}]}]}\n'
               '{"timeline":[]}\n{}\n')
    assert [tuple(r) for r in json_io.json_timeline_rows(spark, p2).collect()] == [("2020-01-01", 2.0)]
    p3 = write(tmp(), "p.json", '{"data":[{"title":"a","created_utc":1},{"title":"b","created_utc":2}]}\n')
    assert json_io.json_post_rows(spark, p3).count() == 2


def test_interest_unpivot(spark):
    df = spark.createDataFrame([("2020-01-05", "10", "<1"), ("2020-01-12", "20", "5")],
                               "`time [UTC]` string, shop string, retail string")
    rows = {(r.term, r.period): r.score for r in normalize_interest(df).collect()}
    assert rows[("shop", dt.date(2020, 1, 5))] == 10.0 and rows[("retail", dt.date(2020, 1, 5))] is None


def test_upsert_latest_wins_keeps_null(spark):
    a = spark.createDataFrame([("s", dt.date(2020, 1, 1), 1.0, 1), ("s", dt.date(2020, 2, 1), 2.0, 1)],
                              "series_id string, period date, v double, load_id int")
    b = spark.createDataFrame([("s", dt.date(2020, 2, 1), None, 2), ("s", dt.date(2020, 3, 1), 3.0, 2)],
                              "series_id string, period date, v double, load_id int")
    got = {r.period: (r.v, r.load_id) for r in upsert_periods(a, b, ["series_id", "period"]).collect()}
    assert got == {dt.date(2020, 1, 1): (1.0, 1), dt.date(2020, 2, 1): (None, 2), dt.date(2020, 3, 1): (3.0, 2)}


def test_generation_stopped_before_publication_changes_nothing(spark):
    base, keys = os.path.join(tmp(), "collected"), ["series_id", "period"]
    jan, feb, mar = (dt.date(2020, m, 1) for m in (1, 2, 3))

    def load(number, *rows):
        return spark.createDataFrame([("s", p, v, number) for p, v in rows],
                                     "series_id string, period date, v double, load_id int")

    def state():
        return {r.period: (r.v, r.load_id, r.attempts, r.failures) for r in upsert.current(spark, base).collect()}

    assert upsert.current(spark, base) is None
    first, second = load(1, (jan, 1.0), (feb, None)), load(2, (feb, None), (mar, 3.0))
    assert upsert.collect_periods(spark, base, first, keys, "v") == 1
    before = {jan: (1.0, 1, 1, 0), feb: (None, 1, 1, 1)}
    assert state() == before
    open_reader = upsert.current(spark, base)
    folder = upsert.write_generation(upsert.with_attempts(upsert.current(spark, base), second, keys, "v"), base)
    assert os.path.isdir(os.path.join(base, folder)) and state() == before  # written, not published
    assert upsert.collect_periods(spark, base, second, keys, "v") == 2
    after = {jan: (1.0, 1, 1, 0), feb: (None, 2, 2, 2), mar: (3.0, 2, 1, 0)}
    assert state() == after
    assert upsert.collect_periods(spark, base, second, keys, "v") == 3     # run again: known already
    assert state() == after
    assert {r.period for r in open_reader.collect()} == {jan, feb}         # an open reader keeps its state
    upsert.collect_periods(spark, base, load(4, (feb, 2.0)), keys, "v")
    assert state()[feb] == (2.0, 4, 3, 2)
    upsert.collect_periods(spark, base, load(5).limit(0), keys, "v")       # nothing collected
    assert len(state()) == 3


def test_versioned_runs_side_by_side(spark):
    base = os.path.join(tmp(), "out")
    df = spark.createDataFrame([("s", 1.0)], "series_id string, v double")
    csv_io.write_versioned(df, base, "r1")
    csv_io.write_versioned(df.withColumn("v", F.lit(2.0)), base, "r2")
    assert csv_io.read_versioned(spark, base, "r1").first().v == 1.0
    assert csv_io.read_versioned(spark, base, "r2").first().v == 2.0


def test_stream_resample_matches_batch_and_is_incremental(spark):
    from mensura.operators.aggregate import resample_monthly
    from mensura.streaming.resample import read_monthly_mean, run_monthly_mean_stream
    base = tmp()
    rows1 = [("a", dt.datetime(2020, 1, 5), 1.0), ("a", dt.datetime(2020, 3, 5), 3.0)]
    rows2 = [("a", dt.datetime(2020, 1, 20), 2.0), ("b", dt.datetime(2020, 2, 1), 5.0)]
    schema = "series_id string, ts timestamp_ntz, value double"
    spark.createDataFrame(rows1, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    run_monthly_mean_stream(spark, f"{base}/src", schema, "ts", "value", f"{base}/out", f"{base}/ck")
    first = {(r.series_id, r.period): r.value for r in read_monthly_mean(spark, f"{base}/out").collect()}
    assert first[("a", dt.date(2020, 1, 1))] == 1.0 and first[("a", dt.date(2020, 2, 1))] is None
    spark.createDataFrame(rows2, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    run_monthly_mean_stream(spark, f"{base}/src", schema, "ts", "value", f"{base}/out", f"{base}/ck")
    got = {(r.series_id, r.period): r.value for r in read_monthly_mean(spark, f"{base}/out").collect()}
    batch = resample_monthly(spark.createDataFrame(rows1 + rows2, schema), "ts", "value")
    want = {(r.series_id, r.period): r.value for r in batch.collect()}
    assert got == want and got[("a", dt.date(2020, 1, 1))] == 1.5


def test_stream_watermark_drops_late_months(spark):
    from mensura.streaming.resample import read_monthly_mean, run_monthly_mean_stream
    schema = "series_id string, ts timestamp_ntz, value double"
    b1 = [("a", dt.datetime(2020, m, 10), float(m)) for m in (1, 2, 3)]
    b2 = [("a", dt.datetime(2020, m, 10), float(m)) for m in (4, 5, 6)] + [("a", dt.datetime(2020, 1, 20), 100.0)]
    got = {}
    for delay in ("31 days", None):
        base = tmp()
        spark.createDataFrame(b1, schema).coalesce(1).write.parquet(f"{base}/src/p1")
        run_monthly_mean_stream(spark, f"{base}/src/*", schema, "ts", "value", f"{base}/out", f"{base}/ck",
                                late_delay=delay)
        spark.createDataFrame(b2, schema).coalesce(1).write.parquet(f"{base}/src/p2")
        run_monthly_mean_stream(spark, f"{base}/src/*", schema, "ts", "value", f"{base}/out", f"{base}/ck",
                                late_delay=delay)
        got[delay] = {r.period: r.value for r in read_monthly_mean(spark, f"{base}/out").collect()}
    jan = dt.date(2020, 1, 1)
    assert got["31 days"][jan] == 1.0      # the late January row arrived after the watermark
    assert got[None][jan] == 50.5          # without a watermark January is updated
    assert got["31 days"][dt.date(2020, 6, 1)] == 6.0


def test_watermark_query_past_the_year_9999(spark):
    """Months that Python's dates do not reach come through as in the batch resample."""
    from mensura.plans.registry import QUERIES, load_all
    load_all()
    base = tmp()
    rows = [(dt.datetime(2024, 1, d, 5), u, e, float(u + d)) for d in (1, 9) for u in (0, 7, 30_000, 50_000) for e in "ab"]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(
        f"{base}/events.parquet")
    got, want = (QUERIES[q](spark, base).selectExpr("series_id", "cast(period as string) AS period", "value")
                 for q in ("ag6_resample_stream_watermark", "ag6_resample_monthly"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 2 * (2 * 50_000 + 1)
    assert got.filter("value IS NOT NULL").count() == 8
