"""Small helpers shared by the query catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.session import scratch_dir

_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one application start from (fitted
    models' predictions): written to the shared folder when first asked for
    and read from there afterwards."""
    key = (spark.conf.get("spark.app.id"), sf_dir, name)
    if key not in _STORED:
        path = f"{scratch_dir(spark, 'stored')}/{name}"
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def r(col: str, digits: int, name: str | None = None) -> Column:
    """Round a double for cross-engine comparison (float sums differ in the
    last bits between engines; the rounding is applied identically in the
    oracle SQL)."""
    return F.round(F.col(col), digits).alias(name or col)


def rs(cols, digits: int) -> list[Column]:
    return [r(c, digits) for c in cols]


def sql_r(col: str, digits: int, name: str | None = None) -> str:
    return f"round({col}, {digits}) AS {name or col}"


def money_mean_4(col: str) -> Column:
    """Aggregate: mean of a non-negative 2-decimal money column, rounded
    HALF_UP to 4 decimals in exact integer arithmetic (cents), so a value
    sitting exactly on a rounding tie cannot round differently depending on
    the floating summation order of an engine."""
    cents = F.sum(F.round(F.col(col) * 100).cast("bigint"))
    n = F.count(col)
    num, den = cents * 200 + n, n * 2
    return (num - F.pmod(num, den)) / den / 10000.0


def sql_money_mean_4(col: str) -> str:
    """DuckDB twin of ``money_mean_4``."""
    s = f"sum(CAST(round({col} * 100) AS BIGINT))"
    return f"((2 * {s} * 100 + count({col})) // (2 * count({col}))) / 10000.0"
