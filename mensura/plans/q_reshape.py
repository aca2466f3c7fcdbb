"""Catalog: reshape (RS), joins (JN), set operations (ST), wide-table
totals and reconciliation (AG2, AG3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.clean import MONTH_ABBR, cyclic_cos, cyclic_sin, parse_money
from mensura.operators import aggregate as ag
from mensura.operators import metrics as mt
from mensura.operators import reshape as rs
from mensura.plans import panels
from mensura.plans.cte import with_views
from mensura.plans.q_core import zero_fc
from mensura.plans.registry import register
from mensura.plans.util import r
from mensura.sources.tables import table


def _long(spark, sf):
    w = panels.rev_wide(spark, sf)
    long = rs.wide_to_long(w, ["series_id", "Year"], MONTH_ABBR, "Month", "Value")
    return long.withColumn("Value", parse_money("Value")).filter(F.col("Value").isNotNull())


@register("rs1_wide_to_long", with_views("""
SELECT series_id, CAST(year(period) AS INTEGER) AS Year, strftime(period, '%b') AS Month, target AS Value
FROM rev_panel""", "rev_panel"))
def rs1(spark, sf):
    return _long(spark, sf).select("series_id", F.col("Year").cast("int").alias("Year"), "Month", "Value")


_MONTH_COLS_SQL = ", ".join(
    f"max(CASE WHEN month(period) = {i + 1} THEN target END) AS {m}" for i, m in enumerate(MONTH_ABBR))


@register("rs2_long_to_wide", with_views(f"""
SELECT series_id, CAST(year(period) AS INTEGER) AS Year, {_MONTH_COLS_SQL}
FROM rev_panel GROUP BY 1, 2""", "rev_panel"))
def rs2(spark, sf):
    p = panels.rev_panel(spark, sf).select(
        "series_id", F.year("period").alias("Year"), F.date_format("period", "MMM").alias("Month"),
        "target")
    return rs.long_to_wide(p, ["series_id", "Year"], "Month", "target", MONTH_ABBR)


@register("rs3_metrics_wide", with_views("""
SELECT series_id, target_kind, round(CASE WHEN var_pop(actual) > 0 THEN
         1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END, 6) AS R2,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100, 6) AS MAPE_pct,
       round(sqrt(sum((actual - predicted) ^ 2) / count(*)), 2) AS RMSE
FROM zero_fc WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2""", "zero_fc"))
def rs3(spark, sf):
    """Metrics -> (combo, metric, value) long table -> one column per metric."""
    m = mt.forecast_metrics(zero_fc(spark, sf), keys=["series_id", "target_kind"], which="B")
    m = m.select("series_id", "target_kind", r("R2", 6), r("MAPE_pct", 6), r("RMSE", 2))
    long = mt.metrics_long(m, ["series_id", "target_kind"], mt.METRIC_NAMES_B)
    return mt.metrics_wide(long, ["series_id", "target_kind"], mt.METRIC_NAMES_B)


@register("rs4_month_dummies", with_views("SELECT series_id, period, " + ", ".join(
    f"CASE WHEN month(period) = {k} THEN 1 ELSE 0 END AS m_{k}" for k in range(2, 13))
    + " FROM rev_panel", "rev_panel"))
def rs4(spark, sf):
    p = panels.rev_panel(spark, sf).select("series_id", "period")
    return rs.month_dummies(p)


@register("rs5_month_spine", with_views("""
SELECT series_id, CAST(unnest(generate_series(CAST(greatest(min(period), DATE '1995-06-01') AS TIMESTAMP),
       CAST(max(period) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period
FROM rev_panel GROUP BY 1""", "rev_panel"))
def rs5(spark, sf):
    return rs.month_spine_of(panels.rev_panel(spark, sf), start="1995-06-01")


# ------------------------------------------------------------------ joins
def _order_covs(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_totalprice")
    return o.groupBy(F.trunc("o_orderdate", "MM").alias("period")).agg(
        F.avg("o_totalprice").alias("avg_order_price"), F.count(F.lit(1)).alias("n_all_orders"))


def _ship_covs(spark, sf):
    li = table(spark, sf, "lineitem", "l_shipdate")
    return li.groupBy(F.trunc("l_shipdate", "MM").alias("period")).agg(
        F.count(F.lit(1)).alias("n_shipped"))


@register("jn1_join_covariates", with_views("""
SELECT r.series_id, r.period, r.target, round(a.avg_order_price, 4) AS avg_order_price,
       a.n_all_orders, b.n_shipped
FROM rev_panel r
LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
                  avg(o_totalprice) AS avg_order_price, count(*) AS n_all_orders
           FROM orders GROUP BY 1) a ON r.period = a.period
LEFT JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, count(*) AS n_shipped
           FROM lineitem GROUP BY 1) b ON r.period = b.period""", "rev_panel"))
def jn1(spark, sf):
    """Two chained left joins of monthly covariates. Each covariate table has
    one row per calendar month (bounded by the calendar, not the data), so it
    is broadcast."""
    base = panels.rev_panel(spark, sf).select("series_id", "period", "target")
    j = rs.join_covariates(base, _order_covs(spark, sf), ["period"])
    j = rs.join_covariates(j, _ship_covs(spark, sf), ["period"], ["n_shipped"])
    return j.select("series_id", "period", "target", r("avg_order_price", 4), "n_all_orders", "n_shipped")


def _wide_parsed(spark, sf):
    w = panels.rev_wide(spark, sf)
    return w.withColumn("FY_Total", parse_money("FY Total"))


_ROW_TOTAL_SQL = " + ".join(f"coalesce(m{i}, 0)" for i in range(1, 13))
_WIDE_SQL = ("(SELECT series_id, CAST(year(period) AS INTEGER) AS Year, "
             + ", ".join(f"max(CASE WHEN month(period) = {i} THEN target END) AS m{i}" for i in range(1, 13))
             + ", CAST(SUM(CAST(target AS DECIMAL(18,2))) AS DOUBLE) AS fy FROM rev_panel GROUP BY 1, 2)")


@register("ag2_year_total", with_views(f"""
SELECT Year, round(coalesce(sum({_ROW_TOTAL_SQL}), 0), 2) AS SumOfMonths FROM {_WIDE_SQL} GROUP BY 1""",
                                       "rev_panel"))
def ag2(spark, sf):
    t = ag.year_total(panels.rev_wide(spark, sf), MONTH_ABBR, ["Year"])
    return t.select("Year", r("SumOfMonths", 2))


@register("ag3_reconcile", with_views(f"""
SELECT Year, round(sum({_ROW_TOTAL_SQL}), 2) AS SumOfMonths, round(sum(fy), 2) AS FY_Total,
       round(sum({_ROW_TOTAL_SQL}) - sum(fy), 2) + 0.0 AS Diff
FROM {_WIDE_SQL} GROUP BY 1""", "rev_panel"))
def ag3(spark, sf):
    w = _wide_parsed(spark, sf)
    detail = ag.year_total(w, MONTH_ABBR, ["Year"])
    rec = ag.reconcile(detail, w, ["Year"], "SumOfMonths", "FY_Total")
    return rec.select("Year", r("SumOfMonths", 2), r("FY_Total", 2),
                      (F.round("Diff", 2) + F.lit(0.0)).alias("Diff"))


@register("jn2_inner_join", with_views(f"""
SELECT series_id, Year, round({_ROW_TOTAL_SQL}, 2) AS SumOfMonths, fy AS FY_Total FROM {_WIDE_SQL}""",
                                       "rev_panel"))
def jn2(spark, sf):
    w = _wide_parsed(spark, sf)
    detail = ag.year_total(w, MONTH_ABBR, ["series_id", "Year"])
    rep = w.select("series_id", "Year", "FY_Total")
    return detail.join(rep, ["series_id", "Year"], "inner").select(
        "series_id", "Year", r("SumOfMonths", 2), "FY_Total")


@register("jn3_missing_periods", with_views("""
SELECT s.series_id, s.period FROM rp_spine s
WHERE NOT EXISTS (SELECT 1 FROM rev_panel r WHERE r.series_id = s.series_id AND r.period = s.period)""",
                                            "rp_spine"))
def jn3(spark, sf):
    return rs.missing_periods(panels.rev_panel(spark, sf))


def walk_forward_folds(df, n_test=24):
    """(series_id, fold_t) for the last ``n_test`` rows of each series."""
    from pyspark.sql import Window
    w = Window.partitionBy("series_id").orderBy(F.col("t").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_test) \
        .select("series_id", F.col("t").alias("fold_t"))


@register("jn5_fold_layout", with_views("""
WITH d AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS INTEGER) AS t
           FROM rev_panel_dense),
f AS (SELECT series_id, t AS fold_t FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rn FROM d)
      WHERE rn <= 24)
SELECT f.series_id, f.fold_t, CAST(count(*) AS BIGINT) AS n_train, min(d.t) AS min_t, max(d.t) AS max_t
FROM f JOIN d ON f.series_id = d.series_id AND d.t < f.fold_t GROUP BY 1, 2""", "rev_panel_dense"))
def jn5(spark, sf):
    from mensura.operators.windows import add_time_index
    d = add_time_index(panels.rev_panel_dense(spark, sf)).select("series_id", "t")
    folds = walk_forward_folds(d)
    j = rs.fold_layout_join(d, folds)
    return j.groupBy("series_id", "fold_t").agg(
        F.count(F.lit(1)).alias("n_train"), F.min("t").alias("min_t"), F.max("t").alias("max_t"))


@register("jn6_snapshot_counts", with_views("""
WITH s AS (SELECT CAST(unnest(generate_series(CAST(min(first_seen) AS TIMESTAMP),
                  CAST(max(last_seen) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period FROM objs)
SELECT s.period, CAST(count(o.obj_id) AS BIGINT) AS alive
FROM s LEFT JOIN objs o ON o.first_seen <= s.period AND o.last_seen >= s.period
GROUP BY 1""", "objs"))
def jn6(spark, sf):
    return rs.snapshot_counts(panels.objs(spark, sf))


def _versions(spark, sf):
    """Orders as versions of a customer: some still open, any day of the month."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.select(F.col("o_custkey").alias("obj_id"), F.col("o_orderdate").cast("date").alias("first_seen"),
                    F.when(F.col("o_orderkey") % 97 != 0, F.date_add(F.col("o_orderdate").cast("date"),
                                                                    (F.col("o_orderkey") % 90).cast("int"))).alias("last_seen"))


@register("jn6_snapshot_versions", """
WITH v AS (SELECT o_custkey AS obj_id, CAST(o_orderdate AS DATE) AS first_seen,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS last_seen FROM orders),
m AS (SELECT unnest(generate_series(date_trunc('month', min(first_seen)), date_trunc('month', max(first_seen)),
                                    INTERVAL 1 MONTH)) AS m FROM v),
s AS (SELECT CAST(m AS DATE) AS period FROM m UNION ALL SELECT CAST(m AS DATE) + 14 FROM m)
SELECT period, CAST(count(DISTINCT obj_id) AS BIGINT) AS alive
FROM s LEFT JOIN v ON first_seen <= period AND (last_seen IS NULL OR last_seen >= period) GROUP BY 1""")
def jn6_versions(spark, sf):
    """Customers alive on the 1st and 15th of every month: overlapping
    versions merged, open ends, lifetimes that start and end on any day."""
    v = _versions(spark, sf)
    months = v.agg(F.trunc(F.min("first_seen"), "MM").alias("lo"), F.trunc(F.max("first_seen"), "MM").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    days = months.select(F.explode(F.array("m", F.date_add("m", 14))).alias("period"))
    return rs.snapshot_counts(v, spine=days, obj="obj_id")


# ------------------------------------------------------------------ set ops
def _order_months(spark, sf):
    return table(spark, sf, "orders", "o_orderdate").select(F.trunc("o_orderdate", "MM").alias("period"))


def _ship_months(spark, sf):
    return table(spark, sf, "lineitem", "l_shipdate").select(F.trunc("l_shipdate", "MM").alias("period"))


@register("st1_intersect", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders
INTERSECT SELECT CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem""")
def st1(spark, sf):
    return _order_months(spark, sf).intersect(_ship_months(spark, sf))


@register("st2_except", """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem
EXCEPT SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders""")
def st2(spark, sf):
    return _ship_months(spark, sf).subtract(_order_months(spark, sf))


@register("st3_union", with_views("""
SELECT 'nation' AS source, series_id, period, target FROM rev_panel
UNION ALL SELECT 'brand' AS source, series_id, period, target FROM part_panel""",
                                  "rev_panel", "part_panel"))
def st3(spark, sf):
    a = panels.rev_panel(spark, sf).select(F.lit("nation").alias("source"), "series_id", "period", "target")
    b = panels.part_panel(spark, sf).select(F.lit("brand").alias("source"), "series_id", "period", "target")
    return rs.union_all(a, b)


@register("st4_with_columns", with_views("""
SELECT series_id, period, CAST(month(period) AS INTEGER) AS month,
       round(sin(2 * pi() * month(period) / 12.0), 9) + 0.0 AS month_sin,
       round(cos(2 * pi() * month(period) / 12.0), 9) + 0.0 AS month_cos,
       CASE WHEN month(period) = 12 THEN 1 ELSE 0 END AS m_12
FROM rev_panel""", "rev_panel"))
def st4(spark, sf):
    """Aligned column blocks attached with one ``withColumns`` (no join)."""
    p = panels.rev_panel(spark, sf).select("series_id", "period")
    m = F.month("period")
    return p.withColumns({
        "month": m, "month_sin": F.round(cyclic_sin(m), 9), "month_cos": F.round(cyclic_cos(m), 9),
        "m_12": F.when(m == 12, 1).otherwise(0)})
