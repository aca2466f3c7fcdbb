"""Sort / limit operators (SO1-SO3, SO6).

Ordering is only applied at sinks; inside a plan, windows carry the order.
Per-series head/tail are ``row_number`` filters (no global sort); a global
top-k is ``orderBy().limit()``, which Spark runs as a partial top-k per
partition (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head(df: DataFrame, n: int, keys: Sequence[str] = ("series_id",), order: str = "period") -> DataFrame:
    """First ``n`` rows of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def tail(df: DataFrame, n: int, keys: Sequence[str] = ("series_id",), order: str = "period") -> DataFrame:
    """Last ``n`` rows of each series (reverse order + limit per series)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, n: int, by: str, descending: bool = True) -> DataFrame:
    """Global top-k report."""
    o = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(o).limit(n)


def rank_features(effects: DataFrame, by: str = "importance", keys: Sequence[str] = ()) -> DataFrame:
    """SO6: order features by importance/|coefficient|, with a rank column."""
    o = F.abs(F.col(by)).desc_nulls_last()
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(o, F.col("feature"))
    return effects.withColumn("rank", F.row_number().over(w))
