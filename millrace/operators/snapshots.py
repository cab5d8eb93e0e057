"""Changes between neighbouring full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def plain_key(value: Column) -> Column:
    """An identifier without outer white space, letter case and, if all digits, leading zeros."""
    bare = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+(?=[0-9])", "")).otherwise(bare)


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of the values as written; a null and an empty value differ, null equals null."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts)


def snapshot_changes(
    df: DataFrame, snapshot: str, keys: dict[str, Column], compared: Sequence[str], updated: str
) -> DataFrame:
    """Rows added, removed and changed between each snapshot and the one before it.

    ``keys`` names the columns of the primary key and gives the expression of each. Where a snapshot
    holds a key more than once, the row with the greatest ``updated`` counts (null is least; among
    equals the one with the greatest row hash, so that the result is the same on every run).
    ``updated`` itself is never compared.

    Returns ``snapshot, *keys, change_kind``. Null key parts equal each other. The first snapshot
    has nothing before it and gives no rows, nor does a table with one snapshot or none. Snapshot
    numbers need not be consecutive: each is held against the next smaller one present.

    Plan: one aggregation to a row (key, snapshot, hash), written once, then a full outer join of that
    result with itself, each row renumbered to the snapshot that follows its own. The table is read
    once; only the key and 16 bytes of state are shuffled. The snapshot numbers, one a delivery, are
    one array.
    """
    state = cut_lineage(
        df.select(F.col(snapshot).alias("_s"), *(v.alias(k) for k, v in keys.items()), row_hash(compared).alias("_h"), F.col(updated).alias("_u"))
        .where(F.col("_s").isNotNull())
        .groupBy("_s", *keys)
        .agg(F.max(F.struct("_u", "_h")).getField("_h").alias("_h"))
    )
    numbers = state.agg(F.sort_array(F.collect_set("_s"))).scalar()
    place = F.array_position(numbers, F.col("_s")).cast("int")
    now = state.where(place > 1).select("_s", *keys, F.col("_h").alias("_now"))
    before = (
        state.withColumn("_next", F.get(numbers, place)).where(F.col("_next").isNotNull())
        .select(F.col("_next").alias("_bs"), *(F.col(k).alias(f"_b_{k}") for k in keys), F.col("_h").alias("_before"))
    )
    on = F.col("_s") == F.col("_bs")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    both = now.join(before, on, "full_outer").where(~F.col("_now").eqNullSafe(F.col("_before")))
    kind = F.when(F.col("_before").isNull(), ADDED).when(F.col("_now").isNull(), REMOVED).otherwise(CHANGED)
    new = F.col("_now").isNotNull()
    return both.select(
        F.coalesce("_s", "_bs").alias(snapshot),
        *(F.when(new, F.col(k)).otherwise(F.col(f"_b_{k}")).alias(k) for k in keys),
        kind.alias("change_kind"),
    )
