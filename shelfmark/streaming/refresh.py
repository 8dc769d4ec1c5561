"""A list that is read again and again; a version that can't be used leaves the last good one in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch with rows replaces the tabs it has in the Parquet table at `path` (one partition a tab); other tabs stay.

    A replayed batch overwrites the same partitions, so a failure between write and commit does no harm.
    """

    def swap(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tab").parquet(path)

    return stream.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Windowed counts of change events with a watermark; over a batch table the same plan without one."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
