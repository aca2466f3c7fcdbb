"""Object-density series (GE1): bounding-box filter -> alive count per
month (as-of snapshot) -> net new objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.filters import bbox_filter
from mensura.operators.reshape import snapshot_counts


def density_series(objs: DataFrame, box: Sequence[float], tag: str = "shop",
                   types: Sequence[str] = ("node", "way", "relation"), obj: str | None = None) -> DataFrame:
    """Monthly (period, shop_count, net_new): objects in the box with the tag
    alive at each month start, and the month-over-month change (first month
    null). ``obj`` names the object of rows that are versions; a version
    outside the box or without the tag ends a lifetime there."""
    alive = snapshot_counts(bbox_filter(objs, box, tag, types), obj=obj)
    w = Window.orderBy("period")  # one row per month: bounded by the calendar
    return alive.select("period", F.col("alive").alias("shop_count"),
                        (F.col("alive") - F.lag("alive", 1).over(w)).alias("net_new"))
