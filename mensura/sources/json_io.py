"""Landed JSON responses -> rows (SRC5-SRC7).

Three response shapes, each one document per line:

* ``{"result": [{"timestamp": str, "value": double}]}``
* ``{"timeline": [{"data": [{"date": str, "value": double}]}, ...]}`` (first
  element only; a missing or empty timeline yields no rows)
* ``{"data": [{"title": str, "created_utc": bigint}]}``

Parsing uses a fixed schema (no inference pass over the files) and
``explode`` of the array, so documents are processed in parallel and a
missing array simply produces no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = "result array<struct<timestamp: string, value: double>>"
TIMELINE_SCHEMA = "timeline array<struct<data: array<struct<date: string, value: double>>>>"
POSTS_SCHEMA = "data array<struct<title: string, created_utc: bigint>>"


def _docs(spark: SparkSession, path: str, schema: str, keep: dict[str, str]) -> DataFrame:
    """One parsed document per line; ``keep`` adds top-level fields
    (name -> type) that are carried next to the exploded rows."""
    ddl = ", ".join([schema] + [f"{k} {t}" for k, t in keep.items()])
    t = spark.read.text(path)
    return t.select(F.from_json("value", ddl).alias("j"))


def _kept(keep: dict[str, str]):
    return [F.col(f"j.{k}").alias(k) for k in keep]


def json_result_rows(spark: SparkSession, path: str, keep: dict[str, str] | None = None) -> DataFrame:
    """SRC5: explode ``result[]`` into (timestamp, value)."""
    keep = keep or {}
    d = _docs(spark, path, RESULT_SCHEMA, keep)
    return d.select(*_kept(keep), F.explode("j.result").alias("e")).select(
        *keep, "e.timestamp", "e.value")


def json_timeline_rows(spark: SparkSession, path: str, keep: dict[str, str] | None = None) -> DataFrame:
    """SRC6: rows of ``timeline[0].data[]``; other timeline entries ignored."""
    keep = keep or {}
    d = _docs(spark, path, TIMELINE_SCHEMA, keep)
    first = F.get(F.col("j.timeline"), 0)
    return d.select(*_kept(keep), F.explode(first.getField("data")).alias("e")).select(
        *keep, "e.date", "e.value")


def json_post_rows(spark: SparkSession, path: str, keep: dict[str, str] | None = None) -> DataFrame:
    """SRC7: (title, created_utc) from ``data[]``."""
    keep = keep or {}
    d = _docs(spark, path, POSTS_SCHEMA, keep)
    return d.select(*_kept(keep), F.explode("j.data").alias("e")).select(
        *keep, "e.title", "e.created_utc")


def write_json_docs(docs: DataFrame, path: str) -> str:
    """Land one JSON document per row (column ``doc``, a struct)."""
    docs.select(F.to_json("doc").alias("value")).write.mode("overwrite").text(path)
    return path
