"""Written results: line-wise JSON, tab-separated hashes and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def length_report(df: DataFrame, text: str) -> DataFrame:
    """``n, mean_chars, p95_chars, mean_tokens, p95_tokens``; nearest-rank percentiles, 4 characters a token, 0 for no rows."""
    size = F.length(text)
    p95 = lambda c: F.coalesce(F.expr(f"percentile_disc(0.95) within group (order by {c})").cast("long"), F.lit(0))
    rows = df.select(size.alias("c"), F.floor(size / 4).alias("t")).where("c is not null")
    mean = lambda c: F.coalesce(F.round(F.avg(c)).cast("long"), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n"), mean("c").alias("mean_chars"), p95("c").alias("p95_chars"), mean("t").alias("mean_tokens"), p95("t").alias("p95_tokens"))


def hashed(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` with each text replaced by its MD5; a null text has the empty string, an empty one the hash of it."""
    return df.withColumns({f"{t}_hash": F.coalesce(F.md5(F.col(t).cast("binary")), F.lit("")) for t in texts}).drop(*texts)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def publish(df: DataFrame, base: str, version: str, *partition: str) -> str:
    """Write a table under a new version; readers take the version they are told, so none sees half of it."""
    path = f"{base}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return path


def append_series(df: DataFrame, path: str, as_of: str) -> None:
    """Add the numbers of one day to a series, replacing that day's if it has them."""
    df.withColumn("as_of", F.lit(as_of).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
