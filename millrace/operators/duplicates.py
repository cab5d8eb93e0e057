"""Exact duplicates among records of one source, and the one that is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import folded


def evidence_key(*texts: Column, sets: Sequence[Column] = ()) -> Column:
    """A digest that records share if their folded texts and their sets of values are equal; null equals null only."""
    parts = [folded(t) for t in texts] + [F.to_json(F.array_sort(F.array_distinct(s))) for s in sets]
    return F.md5(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))).cast("binary"))


def exact_duplicates(df: DataFrame, ident: str, board: str, keys: Sequence[Column], body: Column, first_date: str) -> DataFrame:
    """``ident, kept_id`` of each record that repeats another one's keys and body.

    ``body`` is compared folded; blank bodies never match. The kept record is on the board whose
    earliest ``first_date`` is least (null last; of equals the board with the least id), and there
    it has the latest date (null least; of equals the greatest id). The body enters as a digest, so
    it is never shuffled, and the kept one is found by aggregates alone: a group with a third of all
    records is reduced before the shuffle. Copies of one id count once. No rows for an empty table.
    """
    text = folded(body)
    rows = df.where(text != "").select(
        F.col(ident).alias("_id"), F.col(board).alias("_board"), F.col(first_date).alias("_first"),
        F.md5(F.concat_ws("|", evidence_key(*keys), F.sha2(text, 256)).cast("binary")).alias("_key"),
    )
    far = F.lit("9999-12-31").cast("timestamp")
    boards = rows.groupBy("_key", "_board").agg(
        F.min(F.struct(F.coalesce("_first", far).alias("t"), F.col("_id").alias("i"))).alias("_early"),
        F.max(F.struct(F.col("_first").alias("t"), F.col("_id").alias("i"))).alias("_late"),
        F.min("_id").alias("_low"), F.max("_id").alias("_high"),
    )
    kept = boards.groupBy("_key").agg(F.min_by(F.col("_late.i"), F.col("_early")).alias("_kept"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    found = rows.select("_key", "_id").join(kept.where("_low < _high").select("_key", "_kept"), "_key").where("_id <> _kept")
    return found.select(F.col("_id").alias(ident), F.col("_kept").alias("kept_id")).distinct()
