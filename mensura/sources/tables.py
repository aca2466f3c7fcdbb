"""Parquet table access for the driver tables (one parquet per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; selecting ``cols`` prunes the scan.

    Also prepares a session created elsewhere (e.g. by a scheduler): periods
    are UTC calendar months, so the session time zone is pinned to UTC, and
    a checkpoint folder is made available (the cluster's, if it names one).
    """
    from mensura.session import prepare
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df
