"""Catalog: cleaning scalars (SC) and filters (FL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import clean as C
from mensura.operators import filters as fl
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.q_core import targets, zero_fc
from mensura.plans.registry import register
from mensura.plans.util import r
from mensura.sources.tables import table


# ------------------------------------------------------------------ SC
@register("sc1_parse_money", with_views(
    "SELECT series_id, period, target AS money FROM rev_panel", "rev_panel"))
def sc1(spark, sf):
    """format_number(target, 2) text ("1,234.50") parsed back to a double."""
    p = panels.rev_panel(spark, sf).withColumn("txt", F.format_number("target", 2))
    return p.select("series_id", "period", C.parse_money("txt").alias("money"))


@register("sc2_parse_percent", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DOUBLE) AS pct
FROM lineitem""")
def sc2(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    txt = F.concat((F.col("l_discount").cast("decimal(4,2)") * 100).cast("string"), F.lit("%"))
    return li.select("l_orderkey", "l_linenumber", C.parse_percent(txt).alias("pct"))


def _formatted_dates(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    fmt = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "M/d/yy"))
           .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yy H:mm"))
           .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select("o_orderkey", fmt.alias("txt"))


@register("sc3_parse_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def sc3(spark, sf):
    """Mixed `M/d/yy`, `M/d/yy H:mm` and ISO text; two-digit years pivot at 69."""
    return _formatted_dates(spark, sf).select("o_orderkey", C.parse_date("txt").alias("d"))


@register("sc4_strict_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def sc4(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    txt = F.date_format("o_orderdate", "M/d/yy")
    return o.select("o_orderkey", C.parse_date(txt, ["M/d/yy"], strict=True).alias("d"))


@register("sc5_to_number", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def sc5(spark, sf):
    e = table(spark, sf, "events", "event_id", "props", "event_type")
    return e.select("event_id", C.to_number(F.get_json_object("props", "$.k")).alias("k"),
                    C.to_number("event_type").alias("bad"))


@register("sc6_from_epoch", with_views("""
SELECT post_id, created_utc, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d %H:%M:%S') AS ts_text
FROM posts""", "posts"))
def sc6(spark, sf):
    p = panels.posts(spark, sf)
    return p.select("post_id", "created_utc",
                    F.date_format(C.from_epoch("created_utc"), "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


@register("sc7_fmt_period", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def sc7(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", C.fmt_period("o_orderdate").alias("ym"))


@register("sc8_month_start", with_views("""
SELECT series_id, CAST(year(period) AS INTEGER) AS Year, strftime(period, '%b') AS Month, period
FROM rev_panel""", "rev_panel"))
def sc8(spark, sf):
    from mensura.operators.reshape import wide_to_long
    long = wide_to_long(panels.rev_wide(spark, sf), ["series_id", "Year"]).filter(
        F.col("Value").isNotNull())
    return long.select("series_id", F.col("Year").cast("int").alias("Year"), "Month",
                       C.month_start("Year", "Month").alias("period"))


@register("sc9_calendar", with_views("""
SELECT series_id, period, CAST(month(period) AS INTEGER) AS month,
       CAST(quarter(period) AS INTEGER) AS quarter, CAST(year(period) AS INTEGER) AS year
FROM rev_panel""", "rev_panel"))
def sc9(spark, sf):
    p = panels.rev_panel(spark, sf)
    return p.select("series_id", "period", F.month("period").alias("month"),
                    F.quarter("period").alias("quarter"), F.year("period").alias("year"))


@register("sc10_cyclic", with_views("""
SELECT series_id, period, round(sin(2 * pi() * month(period) / 12.0), 9) + 0.0 AS month_sin,
       round(cos(2 * pi() * month(period) / 12.0), 9) + 0.0 AS month_cos
FROM rev_panel""", "rev_panel"))
def sc10(spark, sf):
    p = panels.rev_panel(spark, sf)
    return p.select("series_id", "period", r_expr(C.cyclic_sin(F.month("period")), 9, "month_sin"),
                    r_expr(C.cyclic_cos(F.month("period")), 9, "month_cos"))


def r_expr(col, digits, name):
    return F.round(col, digits).alias(name)


@register("sc11_log_exp", with_views("""
SELECT series_id, period, round(log_y, 10) AS log_y, round(exp(log_y), 2) AS level,
       round((exp(mom_logdiff) - 1) * 100, 8) AS mom_pct
FROM targets""", "targets"))
def sc11(spark, sf):
    t = targets(spark, sf)
    return t.select("series_id", "period", r("log_y", 10),
                    r_expr(C.exp_level("log_y"), 2, "level"),
                    r_expr(C.pct_effect("mom_logdiff"), 8, "mom_pct"))


@register("sc12_abs_pct_error", with_views("""
SELECT series_id, period, target_kind,
       round(CASE WHEN actual <> 0 THEN abs(predicted - actual) / actual * 100 END, 6) AS abs_pct_error
FROM zero_fc""", "zero_fc"))
def sc12(spark, sf):
    z = zero_fc(spark, sf)
    return z.select("series_id", "period", "target_kind",
                    r_expr(C.abs_pct_error("predicted", "actual"), 6, "abs_pct_error"))


@register("sc14_project", with_views("""
SELECT period, series_id, target AS revenue, n_orders, n_customers, quantity, avg_disc
FROM rev_panel""", "rev_panel"))
def sc14(spark, sf):
    return fl.project(panels.rev_panel(spark, sf), {"target": "revenue"}, first=["period"],
                      drop=["avg_tax"])


@register("sc15_resolve_columns", with_views("""
SELECT series_id, period, target AS revenue, n_orders, n_customers AS ridership FROM rev_panel""",
                                             "rev_panel"))
def sc15(spark, sf):
    p = panels.rev_panel(spark, sf)
    return fl.select_resolved(p, ["series_id", "period"],
                              ["revenue", "unemp", "n_orders", "ridership"],
                              {"revenue": ["target"], "ridership": ["CTA", "n_customers"]})


@register("sc16_weekly_total", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT event_type, CAST(date_trunc('month', day) AS DATE) AS period,
             avg(CASE WHEN dayofweek(day) BETWEEN 1 AND 5 THEN n END) AS wkday_avg,
             avg(CASE WHEN dayofweek(day) = 6 THEN n END) AS sat_avg,
             avg(CASE WHEN dayofweek(day) = 0 THEN n END) AS sun_avg
      FROM d GROUP BY 1, 2)
SELECT event_type, period, round(wkday_avg, 6) AS wkday_avg, round(sat_avg, 6) AS sat_avg,
       round(sun_avg, 6) AS sun_avg, round(5 * wkday_avg + sat_avg + sun_avg, 6) AS weekly_total
FROM m""")
def sc16(spark, sf):
    e = table(spark, sf, "events", "ts", "event_type")
    d = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    dow = F.dayofweek("day")  # 1 = Sunday .. 7 = Saturday
    m = d.groupBy("event_type", F.trunc("day", "MM").alias("period")).agg(
        F.avg(F.when(dow.between(2, 6), F.col("n"))).alias("wkday_avg"),
        F.avg(F.when(dow == 7, F.col("n"))).alias("sat_avg"),
        F.avg(F.when(dow == 1, F.col("n"))).alias("sun_avg"))
    m = m.withColumn("weekly_total", fl.weekly_total("wkday_avg", "sat_avg", "sun_avg"))
    return m.select("event_type", "period", r("wkday_avg", 6), r("sat_avg", 6), r("sun_avg", 6),
                    r("weekly_total", 6))


# ------------------------------------------------------------------ FL
def nulled_orders(spark, sf):
    """orders with CASE-injected nulls in two columns."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return o.select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("prio"))


_NULLED = """(SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS prio FROM orders)"""


@register("fl1_filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def fl1(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return fl.filter_eq(o, "o_orderstatus", "F").select("o_orderkey", "o_totalprice")


@register("fl2_drop_null", f"""
SELECT o_orderkey, price, prio FROM {_NULLED} WHERE price IS NOT NULL AND prio IS NOT NULL""")
def fl2(spark, sf):
    return fl.drop_null(nulled_orders(spark, sf), ["price", "prio"]).select("o_orderkey", "price", "prio")


@register("fl3_drop_blank_rows", f"""
SELECT price, prio FROM {_NULLED} WHERE price IS NOT NULL OR prio IS NOT NULL""")
def fl3(spark, sf):
    return fl.drop_blank_rows(nulled_orders(spark, sf).select("price", "prio"))


@register("fl5_fill_zero", f"SELECT o_orderkey, coalesce(price, 0) AS price, prio FROM {_NULLED}")
def fl5(spark, sf):
    d = fl.fill_zero(nulled_orders(spark, sf), ["price", "not_there"])
    return d.select("o_orderkey", "price", "prio")


_EXCL = ["1996-03", "1998-12", "2000-06"]


@register("fl6_exclude_periods", with_views(f"""
SELECT series_id, period, target FROM rev_panel
WHERE strftime(period, '%Y-%m') NOT IN ({", ".join(f"'{m}'" for m in _EXCL)})""", "rev_panel"))
def fl6(spark, sf):
    return fl.exclude_periods(panels.rev_panel(spark, sf), _EXCL).select("series_id", "period", "target")


@register("fl7_non_empty", with_views("""
SELECT post_id, title FROM posts WHERE length(trim(title)) > 0 AND created_utc IS NOT NULL""",
                                      "posts"))
def fl7(spark, sf):
    return fl.non_empty(panels.posts(spark, sf)).select("post_id", "title")


@register("fl8_keyword_filter", f"""
SELECT d.doc_id FROM documents d JOIN events e ON d.doc_id = e.event_id
WHERE regexp_matches(lower(d.text), '{fl.word_pattern(["the"])}')
  AND regexp_matches(lower(d.text), '{fl.word_pattern(["that", "with", "this"])}')
  AND e.ts >= TIMESTAMP '2024-01-01 12:00:00' AND e.ts < TIMESTAMP '2024-01-03 00:00:00'""")
def fl8(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    e = table(spark, sf, "events", "event_id", "ts")
    j = d.join(e, d.doc_id == e.event_id)
    return fl.keyword_filter(j, "text", ["the"], ["that", "with", "this"], ts="ts",
                             after="2024-01-01 12:00:00", before="2024-01-03 00:00:00").select("doc_id")


@register("fl9_bbox_filter", with_views("""
SELECT obj_id FROM objs WHERE lon BETWEEN 0 AND 5000 AND lat BETWEEN 5 AND 15
  AND shop IS NOT NULL AND osm_type IN ('node')""", "objs"))
def fl9(spark, sf):
    return fl.bbox_filter(panels.objs(spark, sf), (0, 5, 5000, 15), "shop", ["node"]).select("obj_id")

