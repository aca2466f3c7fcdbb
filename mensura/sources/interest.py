"""Search-interest frames (SRC8): ``time [UTC]`` + one column per keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME_COL = "time [UTC]"


def normalize_interest(df: DataFrame, time_col: str = TIME_COL,
                       terms: Sequence[str] | None = None) -> DataFrame:
    """Wide interest frame -> (period, term, score).

    The time column is renamed and parsed to a date; every other column (or
    the given ``terms``) is unpivoted, with scores ``try_cast`` to double.
    """
    terms = list(terms) if terms else [c for c in df.columns if c != time_col]
    d = df.select(F.to_date(F.col(f"`{time_col}`").cast("string")).alias("period"),
                  *[F.col(f"`{t}`").cast("string").alias(t) for t in terms])
    long = d.unpivot(["period"], terms, "term", "score")
    return long.withColumn("score", F.col("score").try_cast("double"))
