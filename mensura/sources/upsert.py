"""Incremental collection (SNK3): latest load wins per key.

``collect_periods`` keeps a collected table as generations: each load writes
the whole merged table into a folder of its own, beside the one in use, and
then publishes it by one small file. A load that stops anywhere before that
file leaves the published table as it was, and a reader sees one whole state,
never parts of two. One writer at a time; folders no longer published stay
until their owner removes them, so readers at work keep theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_periods(existing: DataFrame, batch: DataFrame, keys: Sequence[str],
                   load_col: str = "load_id") -> DataFrame:
    """Merge a new batch into accumulated rows: for each key the row of the
    highest ``load_col`` is kept, even if its value is null (a failed
    collection stays recorded as null until a later load fills it).

    One shuffle by ``keys``; a key present in a single load passes through.
    """
    return latest_wins(existing.unionByName(batch, allowMissingColumns=True), keys, load_col)


def latest_wins(df: DataFrame, keys: Sequence[str], load_col: str = "load_id") -> DataFrame:
    """Keep, per key, the row with the highest ``load_col`` (a key has one
    row per load, so the window group is bounded by the number of loads)."""
    w = Window.partitionBy(*keys).orderBy(F.col(load_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def write_partitions(df: DataFrame, path: str, partition_cols: Sequence[str]) -> str:
    """Dynamic partition overwrite: only partitions present in ``df`` are
    replaced, so a restarted job rewrites exactly what it recomputed."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))
    return path


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------ generations
def _published(spark: SparkSession, base: str):
    """(number, folder) of the generation in use, or None."""
    try:
        notes = spark.read.schema("number long, folder string").json(f"{base}/published")
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = notes.agg(F.max(F.struct("number", "folder")).alias("last")).first()["last"]
    return last


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The published table, or None before the first publication."""
    last = _published(spark, base)
    return None if last is None else spark.read.parquet(f"{base}/{last['folder']}")


def write_generation(df: DataFrame, base: str, partition_cols: Sequence[str] = ()) -> str:
    """Write ``df`` into a folder of its own under ``base``; not yet published."""
    folder = f"generation-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_cols).parquet(f"{base}/{folder}")
    return folder


def publish(spark: SparkSession, base: str, folder: str) -> int:
    """Make ``folder`` the table in use: one row, one file, put in place when
    its write commits. Returns the generation's number."""
    last = _published(spark, base)
    number = 1 if last is None else last["number"] + 1
    note = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(folder).alias("folder"))
    note.coalesce(1).write.mode("append").json(f"{base}/published")
    return number


def with_attempts(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], value: str,
                  load_col: str = "load_id") -> DataFrame:
    """``existing`` merged with ``batch`` (latest load wins) and, per key,
    ``attempts``: the loads that asked for it, and ``failures``: those that
    got null. Loads of a key not later than its stored one are known already
    and change nothing, so a load may be run again. Keys are not null."""
    keys = list(keys)
    if existing is None:
        return latest_wins_counts(batch, keys, value, load_col)
    known = existing.select(*keys, F.col(load_col).alias("_known"))
    fresh = batch.join(known, keys, "left").filter(F.col("_known").isNull() | (F.col(load_col) > F.col("_known")))
    tried = latest_wins_counts(fresh.drop("_known"), keys, value, load_col)
    both = existing.unionByName(tried, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    both = both.withColumns({c: F.sum(c).over(w) for c in ("attempts", "failures")})
    return latest_wins(both, keys, load_col)


def latest_wins_counts(df: DataFrame, keys: Sequence[str], value: str, load_col: str) -> DataFrame:
    """The latest load of each key with its number of loads and of null ones
    (one row per key: partial aggregation, no window over the loads)."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(F.col(load_col), F.col(value).isNotNull()))
    loads = df.groupBy(*keys).agg(latest.alias("_row"), F.countDistinct(load_col).alias("attempts"),
                                  F.countDistinct(F.when(F.col(value).isNull(), F.col(load_col))).alias("failures"))
    return loads.select(*keys, "_row.*", "attempts", "failures")


def collect_periods(spark: SparkSession, base: str, batch: DataFrame, keys: Sequence[str], value: str,
                    load_col: str = "load_id", partition_cols: Sequence[str] = ()) -> int:
    """Merge ``batch`` into the collected table at ``base`` and publish the
    result as its next generation. Returns the generation's number."""
    merged = with_attempts(current(spark, base), batch, keys, value, load_col)
    return publish(spark, base, write_generation(merged, base, partition_cols))
