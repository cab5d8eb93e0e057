"""Per-key results where a few keys hold most rows.

Every step is an algebraic aggregate: each task folds its rows into a hash table of partial states
(Spark spills it by sorting when it outgrows its memory), and only those states are shuffled, at
most one per key and map task. A key with a third of all rows is therefore as cheap to finish as
any other. Distinct counts go through (key, item) first, which hashes the rows of a heavy key over
all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def key_profile(df: DataFrame, key: str, item: str, updated: str) -> DataFrame:
    """Rows, distinct items, surplus copies and latest update of each key.

    Returns ``key, n_rows, n_items, n_duplicates, latest_update``. A null key is a key of its own.
    Rows with a null item count in n_rows and n_duplicates, not in n_items. A key whose ``updated``
    is null in all rows has a null latest_update. An empty table gives no rows. Columns other than
    the three named ones are not read, so their names can't clash.
    """
    by_item = df.groupBy(F.col(key).alias("_key"), F.col(item).alias("_item")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(updated).alias("_latest")
    )
    return by_item.groupBy("_key").agg(
        F.sum("_rows").alias("n_rows"),
        F.count("_item").alias("n_items"),
        (F.sum("_rows") - F.count("_item")).alias("n_duplicates"),
        F.max("_latest").alias("latest_update"),
    ).withColumnRenamed("_key", key)


def combine_by_key(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """``groupBy(keys)`` restricted to aggregates with mergeable partial states."""
    return df.groupBy(*keys).agg(*(value.alias(name) for name, value in aggregates.items()))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys holding at least ``share`` of all rows: ``key, n_rows``.

    The total is the sum over the same per-key counts, which are written once, so the table is read
    once. A null key is counted in the total and is never returned. An empty table gives no rows.
    """
    counts = cut_lineage(combine_by_key(df, [key], n_rows=F.count(F.lit(1))))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.where((F.col("n_rows") >= F.lit(share) * total) & F.col(key).isNotNull())
