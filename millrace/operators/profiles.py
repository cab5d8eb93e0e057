"""What sets groups apart: their shares, the items they mention more than others, the groups nearest to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.nearness import group_nearness


def group_shares(rows: DataFrame, group: str, member: str, level: str) -> DataFrame:
    """``group, n, share, levels``: distinct members, their share of all, and the share of each level among those of the group.

    ``levels`` maps levels to shares; members without one count as ``none``. Rows without a group or member are left out.
    """
    known = rows.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    each = known.groupBy(F.col(group).alias("_g"), F.col(member).alias("_m")).agg(F.min(level).alias("_l"))
    cells = each.groupBy("_g", F.coalesce("_l", F.lit("none")).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    groups = cells.groupBy("_g").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_l", "_n"))).alias("_c"))
    total = groups.agg(F.sum("n")).scalar()
    shares = F.map_from_entries(F.transform("_c", lambda c: F.struct(c["_l"], c["_n"] / F.col("n"))))
    return groups.select(F.col("_g").alias(group), "n", (F.col("n") / total).alias("share"), shares.alias("levels"))


def distinctive_items(mentions: DataFrame, group: str, member: str, item: str, least_share: float = 0.1, top: int = 8) -> DataFrame:
    """``group, item, share, lift, rank``: of each group the ``top`` items by lift among those that a share of its members mention.

    Lift is the item's share in the group over its share among all members. Equal lifts go by the
    item. Repeated mentions count once.
    """
    known = mentions.where(F.col(group).isNotNull() & F.col(member).isNotNull() & F.col(item).isNotNull())
    pairs = known.select(F.col(group).alias("_g"), F.col(member).alias("_m"), F.col(item).alias("_i")).distinct()
    sizes = pairs.groupBy("_g").agg(F.count_distinct("_m").alias("_n"))
    inside = pairs.groupBy("_g", "_i").agg(F.count(F.lit(1)).alias("_k")).join(sizes, "_g").withColumn("share", F.col("_k") / F.col("_n"))
    everyone = pairs.agg(F.count_distinct("_m")).scalar()
    overall = pairs.select("_m", "_i").distinct().groupBy("_i").agg((F.count(F.lit(1)) / everyone).alias("_s"))
    lifted = inside.where(F.col("share") >= least_share).join(overall, "_i").withColumn("lift", F.col("share") / F.col("_s"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc(F.round("lift", 9)), "_i"))
    return lifted.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("_g").alias(group), F.col("_i").alias(item), "share", "lift", "rank")


def nearest_groups(mentions: DataFrame, group: str, member: str, item: str, top: int = 5) -> DataFrame:
    """``group, near_group, nearness, rank``: of each group the ``top`` others by cosine, then by name."""
    pairs = group_nearness(mentions, group, member, item)
    near = f"near_{group}"
    both = pairs.unionByName(pairs.select(F.col(near).alias(group), F.col(group).alias(near), "nearness"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("nearness", 9)), near))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)


def fragments(mentions: DataFrame, group: str, member: str, item: str, least: float = 0.95, least_members: int = 20) -> DataFrame:
    """``group, near_group, nearness``: groups that are likely one: names with the same last word and a cosine of ``least``.

    Groups with fewer members are left out, of the weights too.
    """
    sizes = mentions.groupBy(F.col(group).alias("_g")).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") >= least_members)
    last_word = lambda g: F.element_at(F.split(F.trim(g), r"\s+"), -1)
    pairs = group_nearness(mentions.join(sizes, F.col(group) == F.col("_g"), "left_semi"), group, member, item, last_word)
    return pairs.where(F.col("nearness") >= least)
