"""CSV sources and sinks (SRC1-SRC3, SNK1, SNK2, FL4 input).

CSV columns are read as strings and converted with ``try_cast`` afterwards:
under ANSI mode a plain cast fails on text such as ``5.70%`` or
``"1,234.50"``, and a typed schema at scan time would silently null them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.clean import parse_money


def read_series_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
                    sep: str = ",", thousands: str | None = None,
                    date_cols: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """SRC1/SRC3: header CSV (UTF-8 BOM tolerated) -> typed DataFrame.

    ``types`` maps column -> Spark type for ``try_cast``; with
    ``thousands=','`` numeric columns are cleaned with ``parse_money`` first.
    ``date_cols`` maps column -> date patterns for ``parse_date``.
    """
    from mensura.functions.clean import parse_date

    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    cols = {}
    for c, t in (types or {}).items():
        if thousands and (t in ("double", "float") or t.startswith("decimal")):
            cols[c] = parse_money(c).cast(t)
        else:
            cols[c] = F.col(c).try_cast(t)
    for c, fmts in (date_cols or {}).items():
        cols[c] = parse_date(c, list(fmts))
    return raw.withColumns(cols) if cols else raw


def read_csv_skip(spark: SparkSession, path: str, n_skip: int, schema_ddl: str,
                  sep: str = ",") -> DataFrame:
    """SRC2: CSV whose header follows ``n_skip`` preamble lines.

    Splittable: lines are read by the text source in blocks. Only the lines
    of each file's first block (``_metadata.file_block_start = 0``, at most
    one block of text per file) are numbered, in read order, to drop the
    preamble and the header; every later block is data as it stands. The
    rest is parsed by ``from_csv`` with a fixed schema.
    """
    from pyspark.sql import Window

    t = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    first = t.filter(F.col("_block") == 0).withColumn("_id", F.monotonically_increasing_id())
    pos = F.row_number().over(Window.partitionBy("_file").orderBy("_id")) - 1
    head_block = first.withColumn("_pos", pos).filter(F.col("_pos") > n_skip).select("value")
    lines = head_block.unionByName(t.filter(F.col("_block") > 0).select("value"))
    body = lines.filter(F.length(F.trim("value")) > 0)
    parsed = body.select(F.from_csv("value", schema_ddl, {"sep": sep}).alias("r"))
    return parsed.select("r.*")


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    """SNK1: CSV without index, one file per partition."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)
    return path


def write_versioned(df: DataFrame, base: str, run_id: str, fmt: str = "parquet") -> str:
    """SNK2: every run lands in its own ``run_id=...`` partition, so earlier
    runs stay readable and a reader prunes to one run."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("append")
     .partitionBy("run_id").format(fmt).option("header", True).save(base))
    return base


def read_versioned(spark: SparkSession, base: str, run_id: str, fmt: str = "parquet") -> DataFrame:
    return (spark.read.format(fmt).option("header", True).load(base)
            .filter(F.col("run_id") == run_id))


def write_text_with_header(lines: DataFrame, path: str, header_lines: Sequence[str]) -> str:
    """Write a one-column ``value`` frame as text files, each file starting
    with ``header_lines`` (preamble and/or header row).

    The header goes before the first row of every partition, so it is
    repeated in every part file and nothing funnels through one task.
    """
    head = [F.lit(x) for x in header_lines]
    value = F.col("value").cast("string")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the place in the partition
    out = lines.select(value.alias("value"), first.alias("_first")).select(
        F.explode(F.when(F.col("_first"), F.array(*head, F.col("value"))).otherwise(F.array("value"))).alias("value"))
    out.write.mode("overwrite").text(path)
    return path


def csv_lines(df: DataFrame, sep: str = ",", extra_blank_cols: int = 0) -> DataFrame:
    """Rows -> CSV text lines (quoted as needed), optionally with trailing
    empty fields."""
    line = F.to_csv(F.struct(*[F.col(c).cast("string") for c in df.columns]), {"sep": sep})
    if extra_blank_cols:
        line = F.concat(line, F.lit(sep * extra_blank_cols))
    return df.select(line.alias("value"))
