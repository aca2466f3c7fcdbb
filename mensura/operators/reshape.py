"""Reshape, spine, joins and set operations (RS1-RS5, JN1-JN3, JN5, JN6, ST1-ST4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.clean import MONTH_ABBR, month_number
from mensura.plans.panels import month_spine


def wide_to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str] = tuple(MONTH_ABBR),
                 var: str = "Month", value: str = "Value") -> DataFrame:
    """RS1: melt the month columns into (ids, Month, Value)."""
    return df.unpivot(list(ids), list(cols), var, value)


def long_to_wide(df: DataFrame, row: Sequence[str], col: str, val: str,
                 values: Sequence | None = None) -> DataFrame:
    """RS2: pivot ``col`` into columns; pass ``values`` (e.g. the 12 month
    names) so Spark does not run a job to discover them."""
    g = df.groupBy(*row)
    p = g.pivot(col, list(values)) if values is not None else g.pivot(col)
    return p.agg(F.first(val))


def month_dummies(df: DataFrame, order: str = "period", prefix: str = "m_") -> DataFrame:
    """RS4: ``m_2 .. m_12`` one-hot month indicators (January is the fixed
    baseline, whatever months are present)."""
    m = F.month(order)
    return df.withColumns({f"{prefix}{k}": F.when(m == k, 1).otherwise(0) for k in range(2, 13)})


def month_spine_of(df: DataFrame, keys=("series_id",), order="period", start=None) -> DataFrame:
    """RS5: month-start spine from max(start, first) to last per series."""
    return month_spine(df, keys, order, start)


def join_covariates(base: DataFrame, covs: DataFrame, on: Sequence[str],
                    cols: Sequence[str] | None = None) -> DataFrame:
    """JN1: left join of covariates, right side pruned to ``on + cols``.
    Whether the right side is broadcast is the planner's decision from its
    size (AQE at run time)."""
    right = covs.select(*on, *(cols or [c for c in covs.columns if c not in on]))
    return base.join(right, list(on), "left")


def missing_periods(df: DataFrame, keys=("series_id",), order="period", start=None) -> DataFrame:
    """JN3 / ST2: months on the spine that the series does not have."""
    spine = month_spine(df, keys, order, start)
    return spine.join(df.select(*keys, order), [*keys, order], "left_anti")


def fold_layout_join(df: DataFrame, folds: DataFrame, keys=("series_id",), t: str = "t",
                     fold_t: str = "fold_t") -> DataFrame:
    """JN5: every (fold, training row) pair with ``t < fold_t``.

    Equi-join on the series keys with a range residual, so it stays a hash
    join; rows are multiplied by the folds after them, so join narrow rows.
    """
    f = folds.select(*keys, fold_t)
    return df.join(f, list(keys)).filter(F.col(t) < F.col(fold_t))


def merged_lifetimes(objs: DataFrame, obj: str, first: str = "first_seen", last: str = "last_seen",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Lifetimes of objects that come in several versions (keys, ``obj``,
    first, last): versions that overlap or follow on the next day are one. A
    null ``last`` is an object that still exists. A window holds the versions
    of one object."""
    group = [*keys, obj]
    end = F.coalesce(F.col(last).cast("date"), F.lit("9999-12-31").cast("date"))
    d = objs.filter(F.col(first).isNotNull()).select(*group, F.col(first).cast("date").alias("_from"), end.alias("_to"))
    d = d.filter(F.col("_from") <= F.col("_to"))
    order = Window.partitionBy(*group).orderBy("_from", "_to")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the far end has no next day
    apart = F.when(before.isNull(), 1).when(before >= F.lit("9999-12-31").cast("date"), 0).when(
        F.col("_from") > F.date_add(before, 1), 1).otherwise(0)
    d = d.withColumn("_apart", apart).withColumn("_island", F.sum("_apart").over(order))
    out = d.groupBy(*group, "_island").agg(F.min("_from").alias(first), F.max("_to").alias("_to"))
    return out.select(*group, first, F.when(F.col("_to") < F.lit("9999-12-31").cast("date"), F.col("_to")).alias(last))


def snapshot_counts(objs: DataFrame, first: str = "first_seen", last: str = "last_seen",
                    keys: Sequence[str] = (), spine: DataFrame | None = None, obj: str | None = None) -> DataFrame:
    """JN6: objects alive on each day of ``spine`` (keys, ``period``), by
    default on the first of every month from the first to the last known one:
    ``first <= day`` and ``last`` null (it still exists) or ``>= day``. With
    ``obj``, rows are versions of objects and count once (``merged_lifetimes``).

    Each object gives +1 on its first day and -1 on the day after its last;
    the deltas are summed per day (partial aggregation), and a running sum
    over the days with events and the asked ones gives the counts. This
    replaces the O(objects x days) theta join by O(objects + days). Objects
    without ``first``, or that end before they start, are never alive.
    """
    keys = list(keys)
    if obj is not None:
        objs = merged_lifetimes(objs, obj, first, last, keys)
    life = objs.select(*keys, F.col(first).cast("date").alias("_from"), F.col(last).cast("date").alias("_to")).filter(
        F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_from") <= F.col("_to"))))
    if spine is None:
        bounds = life.groupBy(*keys).agg(F.trunc(F.min("_from"), "MM").alias("_lo"), F.trunc(
            F.greatest(F.max("_from"), F.max("_to")), "MM").alias("_hi"))
        spine = bounds.filter(F.col("_lo").isNotNull()).select(*keys, F.explode(
            F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("period"))
    events = F.array_compact(F.array(
        F.struct(F.col("_from").alias("period"), F.lit(1).alias("d")),
        F.when(F.col("_to").isNotNull(), F.struct(F.date_add("_to", 1).alias("period"), F.lit(-1).alias("d")))))
    deltas = life.select(*keys, F.explode(events).alias("e")).groupBy(*keys, F.col("e.period").alias("period")).agg(
        F.sum("e.d").alias("d"), F.lit(False).alias("asked"))
    days = spine.select(*keys, F.col("period").cast("date").alias("period")).distinct()
    both = deltas.unionByName(days.select(*keys, "period", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("asked")))
    # days of a calendar: a window stays small, however many objects there are
    w = Window.partitionBy(*keys).orderBy("period").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("alive", F.sum("d").over(w).cast("bigint")).filter("asked").select(*keys, "period", "alive")


def union_all(*dfs: DataFrame) -> DataFrame:
    """ST3: union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def month_of_name(col: str):
    return month_number(col)
