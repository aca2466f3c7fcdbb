"""Panels built from the driver tables.

Each builder returns a lazy DataFrame; Catalyst prunes the parquet scans to
the referenced columns and pushes filters into them. Money is summed as
exact DECIMAL and only then turned into DOUBLE, so every engine agrees to the
cent regardless of summation order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.functions.clean import MONTH_ABBR
from mensura.sources.tables import table

REV_COVARIATES = ["n_orders", "n_customers", "quantity", "avg_disc", "avg_tax"]


def _hundredths(col: str, kind: str, most: int) -> F.Column:
    """``col`` cast to the decimal ``kind`` (scale 2, below ``most`` hundredths), in hundredths. A double that is the
    nearest to a number of hundredths is that number; others take the cast, which is slow."""
    value = F.col(col).cast("double")
    n = F.rint(value * 100)
    return F.when((n / 100 == value) & (F.abs(n) < most), n.cast("bigint")).otherwise(
        (F.col(col).cast(kind) * 100).cast("bigint"))


def _disc() -> F.Column:
    return _hundredths("l_discount", "decimal(4,2)", 10**4)


def _tax() -> F.Column:
    return _hundredths("l_tax", "decimal(4,2)", 10**4)


def _line_revenue() -> F.Column:
    """Exact revenue of a line in ten-thousandths."""
    return _hundredths("l_extendedprice", "decimal(12,2)", 10**12) * (F.lit(100).cast("bigint") - _disc())


def _revenue(total: F.Column) -> F.Column:
    """A sum of ``_line_revenue`` as a decimal amount."""
    return total.cast("decimal(28,0)") * F.lit(Decimal("0.0001"))


def order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem pre-aggregated per order (map-side partial aggregation).

    Cuts the rows entering the joins by the lines-per-order factor and leaves
    the result hash-partitioned on the order key, which the following join
    with ``orders`` reuses.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice",
               "l_discount", "l_quantity", "l_tax")
    return li.groupBy("l_orderkey").agg(
        _revenue(F.sum(_line_revenue())).alias("rev"),
        F.sum("l_quantity").alias("qty"),
        F.sum(_disc()).alias("disc_sum"),
        F.sum(_tax()).alias("tax_sum"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def rev_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue per nation: ``(series_id, period, target, covariates)``.

    lineitem (pre-aggregated per order) -> orders -> customer -> nation.
    ``nation`` has a fixed 25 rows and is broadcast; the customer join is left
    to the planner (its size grows with the data, AQE decides at run time).
    """
    per_order = order_revenue(spark, sf_dir)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_name"))
    j = (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey))
    return j.groupBy(
        F.col("n_name").alias("series_id"),
        F.trunc("o_orderdate", "MM").alias("period"),
    ).agg(
        F.round(F.sum("rev"), 2).cast("double").alias("target"),
        F.count(F.lit(1)).alias("n_orders"),
        F.countDistinct("o_custkey").alias("n_customers"),
        F.sum("qty").cast("double").alias("quantity"),
        (F.sum("disc_sum") / 100 / F.sum("n_lines")).alias("avg_disc"),
        (F.sum("tax_sum") / 100 / F.sum("n_lines")).alias("avg_tax"),
    )


def part_panel(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """Monthly revenue per part attribute (``p_brand`` by default)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey",
               "l_extendedprice", "l_discount")
    p = table(spark, sf_dir, "part", "p_partkey", key)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col(key).alias("series_id"),
                     F.trunc("o_orderdate", "MM").alias("period")).agg(
        F.round(_revenue(F.sum(_line_revenue())), 2).cast("double").alias("target"))


SUPP_COVARIATES = ["n_lines", "quantity", "avg_disc", "avg_tax"]


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly shipped revenue per supplier: the many-series panel (its
    series count grows with the data). A single scan of lineitem and one
    partially aggregated ``groupBy``; no join, since the ship month is on
    the line itself."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice",
               "l_discount", "l_quantity", "l_tax")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("series_id"),
                      F.trunc("l_shipdate", "MM").alias("period")).agg(
        F.round(_revenue(F.sum(_line_revenue())), 2).cast("double").alias("target"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").cast("double").alias("quantity"),
        (F.sum(_disc()) / 100 / F.count(F.lit(1))).alias("avg_disc"),
        (F.sum(_tax()) / 100 / F.count(F.lit(1))).alias("avg_tax"))


def supplier_panel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(supplier_panel(spark, sf_dir), ["target"] + SUPP_COVARIATES)


def month_spine(panel: DataFrame, keys=("series_id",), order: str = "period",
                start=None) -> DataFrame:
    """Every month from max(start, first) to last period, per series."""
    keys = list(keys)
    lo = F.min(order)
    if start is not None:
        lo = F.greatest(lo, F.to_date(F.lit(start)))
    b = panel.groupBy(*keys).agg(lo.alias("_lo"), F.max(order).alias("_hi"))
    return b.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month")))
                    .alias(order))


def densify(panel: DataFrame, value_cols, keys=("series_id",), order: str = "period",
            policy: str = "ffill") -> DataFrame:
    """Put every month between a series' first and last period under it and
    fill the holes.

    Each observed row expands itself over the gap up to the next observed
    month (``lead`` + ``explode(sequence)``), so ``policy='ffill'`` carries
    the last value forward without a spine join; ``'zero'`` fills 0. One
    window, one exchange, one pass over the panel. A flag column
    ``imputed`` marks filled rows.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    p = panel.withColumn("_last", F.coalesce(F.add_months(F.lead(order).over(w), -1), F.col(order)))
    d = p.select(*keys, F.col(order).alias("_obs"), *value_cols,
                 F.explode(F.sequence(F.col(order), F.col("_last"), F.expr("interval 1 month"))).alias(order))
    imputed = F.col(order) != F.col("_obs")
    cols = []
    for c in value_cols:
        if policy == "ffill":
            cols.append(F.col(c))
        else:
            cols.append(F.when(imputed, F.lit(0).cast(panel.schema[c].dataType)).otherwise(F.col(c)).alias(c))
    return d.select(*keys, order, *cols, imputed.alias("imputed"))


def rev_panel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(rev_panel(spark, sf_dir), ["target"] + REV_COVARIATES)


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean event value per event type."""
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    return e.groupBy(F.col("event_type").alias("series_id"),
                     F.to_date("ts").alias("period")).agg(
        (F.sum(F.col("value").cast("decimal(12,2)")).cast("double")
         / F.count(F.lit(1))).alias("target"),
        F.count(F.lit(1)).alias("n_events"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to events: (post_id, title = whole text, created_utc)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.col("text").alias("title"))
    e = table(spark, sf_dir, "events", "event_id", "ts")
    return d.join(e, d.doc_id == e.event_id).select(
        F.col("doc_id").alias("post_id"), "title", F.unix_timestamp("ts").alias("created_utc"))


def objs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as map objects: lifetime from first to last order month.

    ``lon``/``lat`` stand in for coordinates (account balance, nation key),
    ``tags`` holds ``shop -> market segment``.
    """
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    life = o.groupBy("o_custkey").agg(
        F.trunc(F.min("o_orderdate"), "MM").alias("first_seen"),
        F.trunc(F.max("o_orderdate"), "MM").alias("last_seen"))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal",
              "c_mktsegment")
    return c.join(life, c.c_custkey == life.o_custkey).select(
        F.col("c_custkey").alias("obj_id"),
        F.when(F.col("c_acctbal") >= 0, F.lit("node")).otherwise(F.lit("way")).alias("osm_type"),
        F.col("c_acctbal").alias("lon"),
        F.col("c_nationkey").cast("double").alias("lat"),
        F.create_map(F.lit("shop"), F.col("c_mktsegment")).alias("tags"),
        "first_seen", "last_seen")


def rev_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rev_panel as a Year x Jan..Dec text table (``"1,234.50"``) + FY Total."""
    p = rev_panel(spark, sf_dir).select(
        "series_id", F.year("period").alias("Year"),
        F.date_format("period", "MMM").alias("mon"), "target")
    wide = p.groupBy("series_id", "Year").pivot("mon", MONTH_ABBR).agg(
        F.first(F.format_number("target", 2)))
    tot = p.groupBy("series_id", "Year").agg(
        F.format_number(F.sum(F.col("target").cast("decimal(18,2)")), 2).alias("FY Total"))
    return wide.join(tot, ["series_id", "Year"])
