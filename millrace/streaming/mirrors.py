"""Streams: mirrors kept up to date by arriving snapshots, and events in windows and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.mirror import reconcile


def follow_snapshots(spark: SparkSession, arriving: str, schema: str, mirror: str, checkpoint: str, scope: str, key: str, compared: Sequence[str]) -> StreamingQuery:
    """Mirror the records of each batch of files that arrives; a scope with records in it is replaced by them.

    Each batch writes ``mirror/batch=N``, complete, so a batch that is run again writes the same; the
    last one is the mirror. Batch 0 begins with an empty one; a later batch whose predecessor can't be
    read fails, so that no scope is lost.
    """

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        published = batch.groupBy(scope, key).agg(F.max(F.struct(*compared)).alias("_r")).select(scope, key, "_r.*")
        held = session.read.parquet(f"{mirror}/batch={number - 1}") if number else published.limit(0)
        outcome = published.select(scope).distinct().withColumn("outcome", F.lit("published"))
        reconcile(held, published, scope, key, compared, outcome)[0].write.mode("overwrite").parquet(f"{mirror}/batch={number}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of a value in windows; rows later than the watermark are dropped by a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Start, end and size of runs of a key's events no further apart than ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
