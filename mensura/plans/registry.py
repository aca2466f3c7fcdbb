"""Query registry: one key per operator ID, each with an optional SQL oracle.

Keys are ``<id>_<short name>`` in lower case (for example ``wn1_lags``).
A query is a callable ``(spark, sf_dir) -> DataFrame``; its oracle is DuckDB
SQL over the same parquet tables, or ``None`` when only a rows/property check
applies (model fits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so their ``@register`` calls run."""
    from mensura.plans import (  # noqa: F401
        q_core, q_clean, q_reshape, q_io, q_models, q_text, q_flows, q_optional,
    )
