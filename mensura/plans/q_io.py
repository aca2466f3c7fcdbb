"""Catalog: sources and sinks (SRC, SNK) and the blank-column CSV (FL4).

Each query first lands stand-in files derived from the driver tables in a
fresh folder under the shared checkpoint location, then runs the source or
sink operator on them and returns the lazily read result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import filters as fl
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.registry import register
from mensura.session import scratch_dir
from mensura.sources import csv_io, json_io, upsert
from mensura.sources.interest import TIME_COL, normalize_interest
from mensura.sources.upsert import read_partitions, upsert_periods, write_partitions

PANEL_COLS = ["series_id", "period", "target", "n_orders", "n_customers", "quantity", "avg_disc"]
PANEL_TYPES = {"period": "date", "target": "double", "n_orders": "bigint",
               "n_customers": "bigint", "quantity": "double", "avg_disc": "double"}
PANEL_DDL = ("series_id string, period date, target double, n_orders bigint, "
             "n_customers bigint, quantity double, avg_disc double")
PANEL_SQL = with_views("SELECT " + ", ".join(PANEL_COLS) + " FROM rev_panel", "rev_panel")


def _panel(spark, sf):
    return panels.rev_panel(spark, sf).select(*PANEL_COLS)


@register("src1_csv_tab", PANEL_SQL)
def src1(spark, sf):
    """Tab-separated header CSV round trip, strings then try_cast."""
    path = csv_io.write_csv(_panel(spark, sf), scratch_dir(spark, "src1"), sep="\t")
    return csv_io.read_series_csv(spark, path, PANEL_TYPES, sep="\t").select(*PANEL_COLS)


@register("src2_csv_preamble", PANEL_SQL)
def src2(spark, sf):
    """CSV with 11 preamble lines before the header in every file."""
    preamble = [f"Series report line {i}" for i in range(1, 11)] + [""]
    lines = csv_io.csv_lines(_panel(spark, sf))
    path = csv_io.write_text_with_header(lines, scratch_dir(spark, "src2"),
                                         preamble + [",".join(PANEL_COLS)])
    return csv_io.read_csv_skip(spark, path, 11, PANEL_DDL)


@register("src3_csv_thousands", PANEL_SQL)
def src3(spark, sf):
    """Money written with thousands separators (quoted "1,234.50")."""
    p = _panel(spark, sf).withColumn("target", F.format_number("target", 2))
    path = csv_io.write_csv(p, scratch_dir(spark, "src3"))
    return csv_io.read_series_csv(spark, path, PANEL_TYPES, thousands=",").select(*PANEL_COLS)


@register("snk1_write_csv", PANEL_SQL)
def snk1(spark, sf):
    path = csv_io.write_csv(_panel(spark, sf), scratch_dir(spark, "snk1"))
    return csv_io.read_series_csv(spark, path, PANEL_TYPES).select(*PANEL_COLS)


RUN_A, RUN_B = "20260101_000000", "20260706_114126"


@register("snk2_versioned", with_views(
    "SELECT " + ", ".join(PANEL_COLS) + f", '{RUN_B}' AS run_id FROM rev_panel", "rev_panel"))
def snk2(spark, sf):
    """Two runs land side by side; reading one run prunes to its partition."""
    base = scratch_dir(spark, "snk2")
    p = _panel(spark, sf)
    csv_io.write_versioned(p.filter(F.col("period") < "1998-01-01"), base, RUN_A)
    csv_io.write_versioned(p, base, RUN_B)
    return csv_io.read_versioned(spark, base, RUN_B).select(*PANEL_COLS, "run_id")


@register("snk3_upsert", with_views("""
WITH l1 AS (SELECT series_id, period, target, 1 AS load_id FROM rev_panel WHERE period < DATE '2000-01-01'),
l2 AS (SELECT series_id, period,
              CASE WHEN period = DATE '1999-06-01' THEN NULL ELSE target + 1 END AS target, 2 AS load_id
       FROM rev_panel WHERE period >= DATE '1998-01-01'),
u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT series_id, period, target, load_id FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY load_id DESC) AS rn FROM u)
WHERE rn = 1""", "rev_panel"))
def snk3(spark, sf):
    """Load 1 covers up to 1999, load 2 restates from 1998 on (values +1)
    and has a failed month (null). Merged, written with dynamic partition
    overwrite per year, read back."""
    p = panels.rev_panel(spark, sf).select("series_id", "period", "target")
    l1 = p.filter(F.col("period") < "2000-01-01").withColumn("load_id", F.lit(1))
    l2 = p.filter(F.col("period") >= "1998-01-01").select(
        "series_id", "period",
        F.when(F.col("period") == F.lit("1999-06-01").cast("date"), F.lit(None).cast("double"))
        .otherwise(F.col("target") + 1).alias("target"), F.lit(2).alias("load_id"))
    merged = upsert_periods(l1, l2, ["series_id", "period"]).withColumn("year", F.year("period"))
    path = write_partitions(merged, scratch_dir(spark, "snk3"), ["year"])
    return read_partitions(spark, path).select("series_id", "period", "target", "load_id")


@register("snk3_generations", with_views("""
WITH l1 AS (SELECT series_id, period, target, 1 AS load_id FROM rev_panel WHERE period < DATE '2000-01-01'),
l2 AS (SELECT series_id, period,
              CASE WHEN period = DATE '1999-06-01' THEN NULL ELSE target + 1 END AS target, 2 AS load_id
       FROM rev_panel WHERE period >= DATE '1998-01-01'),
u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT series_id, period, arg_max(coalesce(target, -1), load_id) AS target, max(load_id) AS load_id,
       count(*) AS attempts, count(*) - count(target) AS failures
FROM u GROUP BY 1, 2""", "rev_panel"))
def snk3_generations(spark, sf):
    """Two loads collected as published generations. The second stops once
    before it is published and is run again; a third run of it is known
    already. The failed month (null, -1 here) keeps its count."""
    p = panels.rev_panel(spark, sf).select("series_id", "period", "target", F.year("period").alias("year"))
    l1 = p.filter(F.col("period") < "2000-01-01").withColumn("load_id", F.lit(1))
    l2 = p.filter(F.col("period") >= "1998-01-01").withColumn("load_id", F.lit(2)).withColumn(
        "target", F.when(F.col("period") != F.lit("1999-06-01").cast("date"), F.col("target") + 1))
    base, keys = scratch_dir(spark, "snk3"), ["series_id", "period"]
    upsert.collect_periods(spark, base, l1, keys, "target", partition_cols=["year"])
    merged = upsert.with_attempts(upsert.current(spark, base), l2, keys, "target")
    upsert.write_generation(merged, base, ["year"])  # stops here: not published
    for _ in range(2):
        upsert.collect_periods(spark, base, l2, keys, "target", partition_cols=["year"])
    return upsert.current(spark, base).select(
        *keys, F.coalesce("target", F.lit(-1.0)).alias("target"), "load_id", "attempts", "failures")


@register("fl4_drop_unnamed", PANEL_SQL)
def fl4(spark, sf):
    """CSV with three blank-named trailing columns and blank rows: drop the
    ``_cN`` columns (FL4) and the all-null rows (FL3), then type."""
    p = _panel(spark, sf)
    lines = csv_io.csv_lines(p, extra_blank_cols=3)
    blank = spark.range(1).select(F.lit(",,,,,,,,,").alias("value"))  # one blank line
    path = csv_io.write_text_with_header(lines.unionByName(blank), scratch_dir(spark, "fl4"),
                                         [",".join(PANEL_COLS) + ",,,"])
    raw = spark.read.option("header", True).csv(path)
    clean = fl.drop_blank_rows(fl.drop_unnamed(raw))
    return clean.select(*[F.col(c).try_cast(PANEL_TYPES[c]).alias(c) if c in PANEL_TYPES else c
                          for c in PANEL_COLS])


# ------------------------------------------------------------------ JSON
_EVENT_SQL = with_views("SELECT series_id, period, target AS value FROM event_panel", "event_panel")


def _weekly_docs(spark, sf, array_col):
    ep = panels.event_panel(spark, sf)
    return ep, ep.groupBy("series_id", F.date_trunc("week", "period").alias("wk"))


@register("src5_json_result", _EVENT_SQL)
def src5(spark, sf):
    """``{"result": [{timestamp, value}]}`` documents, one per type and week."""
    ep, g = _weekly_docs(spark, sf, "result")
    docs = g.agg(F.collect_list(F.struct(
        F.date_format("period", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("target").alias("value"))).alias("result"))
    docs = docs.select(F.struct("series_id", "result").alias("doc"))
    path = json_io.write_json_docs(docs, scratch_dir(spark, "src5"))
    rows = json_io.json_result_rows(spark, path, {"series_id": "string"})
    return rows.select("series_id", F.to_date(F.to_timestamp("timestamp")).alias("period"), "value")


@register("src6_json_timeline", _EVENT_SQL)
def src6(spark, sf):
    """``{"timeline": [{"data": [...]}, {...}]}``: only the first timeline
    entry counts; documents with an empty timeline give no rows."""
    ep, g = _weekly_docs(spark, sf, "timeline")
    docs = g.agg(
        F.collect_list(F.struct(F.date_format("period", "yyyy-MM-dd").alias("date"),
                                F.col("target").alias("value"))).alias("d0"),
        F.collect_list(F.struct(F.date_format("period", "yyyy-MM-dd").alias("date"),
                                F.col("n_events").cast("double").alias("value"))).alias("d1"))
    docs = docs.select(F.struct("series_id", F.array(F.struct(F.col("d0").alias("data")),
                                                     F.struct(F.col("d1").alias("data")))
                                .alias("timeline")).alias("doc"))
    empty = ep.select("series_id").distinct().select(F.struct(
        "series_id", F.array().cast("array<struct<data: array<struct<date: string, value: double>>>>")
        .alias("timeline")).alias("doc"))
    path = json_io.write_json_docs(docs.unionByName(empty), scratch_dir(spark, "src6"))
    rows = json_io.json_timeline_rows(spark, path, {"series_id": "string"})
    return rows.select("series_id", F.to_date("date").alias("period"), "value")


@register("src7_json_posts", with_views("SELECT title, created_utc FROM posts", "posts"))
def src7(spark, sf):
    """``{"data": [{title, created_utc}]}`` documents of at most 100 posts
    each (blocks of post ids), like paged API responses; titles are whole texts."""
    p = panels.posts(spark, sf)
    docs = p.groupBy(F.floor(F.col("post_id") / 100).alias("page")).agg(
        F.collect_list(F.struct("title", "created_utc")).alias("data"))
    path = json_io.write_json_docs(docs.select(F.struct("data").alias("doc")),
                                   scratch_dir(spark, "src7"))
    return json_io.json_post_rows(spark, path)


@register("src8_interest_frame", with_views(
    "SELECT period, series_id AS term, target AS score FROM event_panel", "event_panel"))
def src8(spark, sf):
    """Wide search-interest CSV (``time [UTC]`` + one column per term) ->
    (period, term, score)."""
    ep = panels.event_panel(spark, sf)
    wide = ep.groupBy(F.col("period").cast("string").alias(TIME_COL)).pivot("series_id").agg(
        F.first("target"))
    path = csv_io.write_csv(wide, scratch_dir(spark, "src8"))
    raw = spark.read.option("header", True).csv(path)
    return normalize_interest(raw).filter(F.col("score").isNotNull())
