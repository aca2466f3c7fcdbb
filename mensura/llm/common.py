"""Helpers shared by the operators of this package.

Tables that are read more than once are written to the shared folder named by
``spark.checkpoint.dir`` (``stage_table``), so a lost executor costs a reread
and never a recomputation that could come out in another order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.session import scratch_dir

#: The white space that the contracts name: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage_table(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """Write ``df`` under the shared folder and read it back. Most such
    tables are hashes and counts, which do not compress; the codecs' buffers
    outside the heap would pile up over many small files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, 'llm')}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(df: DataFrame) -> Column:
    """64 bits of a row's whole content; rows that agree in ``doc_id`` and
    this key are treated as repeats of one row. Maps cannot be hashed and
    are left out."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*columns)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality on ``columns``."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def apart(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns whose names begin with an underscore, as working
    columns here do, under other names; and all its columns under their own
    names, to be selected in the end."""
    taken = {c.lower() for c in df.columns}
    other = {}
    for c in df.columns:
        if c.startswith("_"):
            other[c] = "x" + c
            while other[c].lower() in taken:
                other[c] = "x" + other[c]
            taken.add(other[c].lower())
    return df.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns]


def running_totals(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str],
                   value: str | None, rows: int, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` (rows, if None) over the rows of the
    same ``groups`` that come before, in the order of the 64-bit hash
    ``order`` taken in buckets, then ``ties``.

    Works in two levels, so that a group holding most rows is still spread:
    sums by (group, bucket) are combined before the shuffle and added up along
    the buckets, and a window runs inside each bucket only. There are
    sqrt(``rows``) buckets, so neither level sees more than about
    sqrt(``rows``) rows of a group at once. ``df`` must be a stored table: it
    is read twice.
    """
    buckets = max(1, math.isqrt(max(rows, 1)))
    each = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    d = df.withColumn("_bucket", F.pmod(F.col(order), F.lit(buckets).cast("long")))
    keys = [*groups, "_bucket"]
    sums = d.groupBy(*keys).agg(F.sum(each).alias("_sum"))
    along = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy(*keys).orderBy(order, *ties)
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = d.withColumn("_inside", F.coalesce(F.sum(each).over(inside), F.lit(0)))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & ranked[k].eqNullSafe(starts[f"_k{i}"])
    return (ranked.join(starts, on)
            .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
            .drop(*[f"_k{i}" for i in range(len(keys))], "_start", "_inside", "_bucket"))


def sorted_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place, from 0, in a global sort. Range
    partitions are numbered by themselves; only one count per partition meets
    in one task."""
    placed = stage_table(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    inside = placed.withColumn("_part", part)
    return (inside.join(starts, "_part")
            .withColumn(name, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
            .drop("_part", "_start", "_at"))


def keep_rows(docs: DataFrame, decisions: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` as often as ``decisions`` says.

    ``decisions`` has one row per row of ``docs``: ``doc_id``, ``row_key``
    (``row_key(docs)``) and ``copies``. Rows that repeat each other wholly
    share their copies; with ``once`` they have one at most. The columns of
    ``docs`` come back unchanged.
    """
    copies = F.max("copies") if once else F.sum("copies")
    wanted = (decisions.groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"))
              .agg(copies.cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
              .filter("_copies > 0"))
    wanted = stage_table(wanted, "wanted")
    docs, columns = apart(docs)
    keyed = docs.withColumn("_row_key", row_key(docs))
    on = keyed["doc_id"].eqNullSafe(F.col("_doc")) & (keyed["_row_key"] == F.col("_key"))
    repeat = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    single = keyed.join(wanted.filter("_rows = 1"), on).withColumn("_copy", repeat).select(*columns)
    many = wanted.filter("_rows > 1")
    if many.isEmpty():
        return single
    one = keyed.join(many, on).dropDuplicates(["_doc", "_key"])
    return single.unionByName(one.withColumn("_copy", repeat).select(*columns))
