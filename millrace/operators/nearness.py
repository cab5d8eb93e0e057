"""How near groups are by what their members mention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage, rows_within

#: Groups up to which pairs that share no item are listed, with 0.
MOST_GROUPS = 2_000


def group_nearness(mentions: DataFrame, group: str, member: str, item: str, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """``group, near_group, nearness``: the cosine of each pair of groups, the smaller name first.

    A group's weight of an item is the share of its members that mention it times ln(N / df), N
    being all members and df those that mention the item. Items of weight 0 drop out, and with them
    groups without any. The pairs come from joining the weights on the item. Groups are few by nature
    (roles, departments); up to MOST_GROUPS of them, each pair that shares no item is listed too, with
    0, beyond that such pairs have no row. With ``block``, a key of the group's name, only groups of one
    key meet, and pairs that share no item have no row.
    """
    rows = mentions.where(F.col(group).isNotNull() & F.col(member).isNotNull() & F.col(item).isNotNull())
    pairs = rows.select(F.col(group).alias("g"), F.col(member).alias("m"), F.col(item).alias("i")).distinct()
    members = pairs.select("g", "m").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    everyone = pairs.agg(F.count_distinct("m")).scalar()
    shares = pairs.groupBy("g", "i").agg(F.count(F.lit(1)).alias("k"))
    spread = pairs.select("i", "m").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    weights = (
        shares.join(members, "g").join(spread, "i")
        .select("g", "i", (F.col("k") / F.col("n") * F.ln(everyone / F.col("df"))).alias("w")).where("w > 0")
    )
    weights = cut_lineage(weights)
    lengths = weights.groupBy("g").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("l"))
    key = F.lit(0) if block is None else block(F.col("g"))
    unit = weights.join(lengths, "g").select("g", "i", key.alias("k"), (F.col("w") / F.col("l")).alias("u"))
    a, b = unit.alias("a"), unit.alias("b")
    shared = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.g") < F.col("b.g"))).groupBy(F.col("a.g").alias("g"), F.col("b.g").alias("h")).agg(F.sum(F.col("a.u") * F.col("b.u")).alias("c"))
    found = shared
    if block is None and rows_within(lengths, MOST_GROUPS):
        names = lengths.agg(F.sort_array(F.collect_list("g")).alias("all"))
        grid = names.select(F.explode("all").alias("g"), "all").select("g", F.explode(F.filter("all", lambda x: x > F.col("g"))).alias("h"))
        found = grid.join(shared, ["g", "h"], "left")
    return found.select(F.col("g").alias(group), F.col("h").alias(f"near_{group}"), F.coalesce("c", F.lit(0.0)).alias("nearness"))
