"""Events in time: gaps, spans, grids and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def silent_gaps(df: DataFrame, key: str, at: str, seconds: int, bucket: str = "day") -> DataFrame:
    """``key, gap_start, gap_end, gap_seconds`` of each pause above ``seconds`` between events of a key.

    Events are ordered within buckets of time, so a key with most events is spread over tasks; the
    pauses across buckets come from the first and last event of each, in order of the buckets.
    """
    rows = df.where(F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.date_trunc(bucket, at).alias("_b"))
    inside = rows.select("_k", F.lag("_t").over(Window.partitionBy("_k", "_b").orderBy("_t")).alias("gap_start"), F.col("_t").alias("gap_end"))
    ends = rows.groupBy("_k", "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    across = ends.select("_k", F.lag("_last").over(Window.partitionBy("_k").orderBy("_b")).alias("gap_start"), F.col("_first").alias("gap_end"))
    gaps = inside.unionByName(across).withColumn("gap_seconds", _seconds(F.col("gap_end"), F.col("gap_start")))
    return gaps.where(F.col("gap_seconds") > seconds).withColumnRenamed("_k", key)


def spans(df: DataFrame, key: str, at: str, tie: str, state: str, bucket: str = "day") -> DataFrame:
    """``key, state, first_at, last_at, n``: runs of rows of a key, in order of ``at`` and ``tie``, in which a state stays the same.

    As in silent_gaps, rows are ordered within buckets of time; what a bucket's first row follows,
    and how many runs began before it, comes from one row a bucket.
    """
    rows = df.where(F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(tie).alias("_i"), F.struct(F.col(state).alias("s")).alias("_s"), F.date_trunc(bucket, at).alias("_b"))
    inside, buckets = Window.partitionBy("_k", "_b").orderBy("_t", "_i"), Window.partitionBy("_k").orderBy("_b")
    marked = rows.withColumn("_new", F.when(F.lag("_s").over(inside).isNull(), 0).when(F.lag("_s").over(inside) == F.col("_s"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy("_k", "_b").agg(F.min(F.struct("_t", "_i", "_s"))["_s"].alias("_first"), F.max(F.struct("_t", "_i", "_s"))["_s"].alias("_last"))
    runs = marked.groupBy("_k", "_b").agg(F.sum("_new").alias("_more"))
    opens = edges.join(runs, ["_k", "_b"]).withColumn("_opens", F.when(F.lag("_last").over(buckets) == F.col("_first"), 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("_more") + F.col("_opens")).over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_opens")
    offsets = opens.select(F.col("_k").alias("_ok"), F.col("_b").alias("_ob"), before.alias("_before"))
    joined = marked.join(offsets, F.col("_k").eqNullSafe(F.col("_ok")) & (F.col("_b") == F.col("_ob"))).withColumn("_run", F.col("_run") + F.col("_before"))
    grouped = joined.groupBy("_k", "_run").agg(F.first("_s")["s"].alias(state), F.min("_t").alias("first_at"), F.max("_t").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("_k").alias(key), state, "first_at", "last_at", "n")


def minute_grid(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``key, minute, value``: a row a minute between a key's first and last event, the last value carried forward."""
    by_minute = df.groupBy(key, F.date_trunc("minute", at).alias("minute")).agg(F.max_by(value, at).alias("_value"))
    grid = by_minute.groupBy(key).agg(F.explode(F.sequence(F.min("minute"), F.max("minute"), F.expr("interval 1 minute"))).alias("minute"))
    carried = F.last("_value", ignorenulls=True).over(Window.partitionBy(key).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(by_minute, [key, "minute"], "left").select(key, "minute", carried.alias(value))


def log_fields(line: Column) -> tuple[Column, Column, Column]:
    """Time, kind and ``k=v`` fields of a log line ``TIME ... KIND k=v k=v``; nulls where it is no such line."""
    time = F.try_to_timestamp(F.regexp_extract(line, r"^(\S+)", 1))
    kind = F.nullif(F.regexp_extract(line, r"\b([A-Z][A-Z_]+)\b(?=\s+\w+=|\s*$)", 1), F.lit(""))
    fields = F.map_from_entries(F.transform(F.regexp_extract_all(line, F.lit(r"\b(\w+=\S+)"), F.lit(1)), lambda x: F.struct(F.split(x, "=", 2)[0], F.split(x, "=", 2)[1])))
    return time, kind, fields
