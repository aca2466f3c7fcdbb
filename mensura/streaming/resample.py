"""Monthly resample (AG6) as a Structured Streaming job.

New files landing in a folder are folded into running monthly means per
series: Spark keeps ``(sum, count)`` per (series, month) in its state store
and, in ``update`` mode, emits the full current mean for every group touched
by a micro-batch. ``foreachBatch`` lands each batch's updates in its own
``batch_id=N`` folder (rewriting that folder if a batch is replayed after a
failure, so delivery is exactly-once per batch). Readers merge the folders
latest-batch-wins (SNK3) and put the month spine under the result, so empty
months appear as nulls exactly as in the batch operator.

Calendar months cannot be expressed with ``window()`` (fixed durations only),
so the grouping key is ``trunc(ts, 'MM')``; its state is bounded by
series x months, not by the event volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.plans.panels import month_spine
from mensura.sources.upsert import latest_wins


def run_monthly_mean_stream(spark: SparkSession, source_dir: str, schema: str, ts: str, value: str,
                            out_dir: str, checkpoint_dir: str, keys: Sequence[str] = ("series_id",),
                            name: str = "value", files_per_batch: int | None = None,
                            late_delay: str | None = None) -> None:
    """Process every file currently in ``source_dir`` (``availableNow``) and
    stop; re-running later picks up only new files (checkpointed offsets).

    ``late_delay`` (e.g. ``"62 days"``) puts a watermark on the month-start
    column, which is also the grouping key, so Spark evicts the state of
    months older than the watermark and ignores rows that arrive for them:
    bounded state for an endless stream. Without it every month stays
    updatable (exact, state grows with series x months).
    """
    keys = list(keys)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.parquet(source_dir).withColumn("_month", F.date_trunc("month", F.col(ts)))
    if late_delay:
        src = src.withWatermark("_month", late_delay)
    agg = (src.groupBy(*keys, "_month").agg(F.avg(value).alias(name))
           .select(*keys, F.to_date("_month").alias("period"), name))

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out_dir}/batch_id={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(land)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def read_monthly_mean(spark: SparkSession, out_dir: str, keys: Sequence[str] = ("series_id",),
                      name: str = "value") -> DataFrame:
    """Latest value per (series, month) over all landed batches, on the
    month spine of each series."""
    keys = list(keys)
    landed = spark.read.parquet(out_dir)
    latest = latest_wins(landed, [*keys, "period"], "batch_id").drop("batch_id")
    spine = month_spine(latest, keys, "period")
    return spine.join(latest, [*keys, "period"], "left").select(*keys, "period", name)
