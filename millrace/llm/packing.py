"""Items of varying length packed into containers of one capacity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs on average; more items make more groups, never larger ones.
GROUP_ITEMS = 20_000


def best_fit(items: list[tuple[int, int, int]], capacity: int, barred: dict[int, int] | None = None) -> list[int]:
    """The bin of each item (size, source, cluster), with bins numbered from 0.

    Items go from the longest to the shortest. Bins are ordered by the room left in them: a bit set
    of rooms gives the successor of the item's size, the tightest bin, and the search goes on
    upwards until a bin's bitmaps allow the item. Its cluster bitmap bars a second item of one
    cluster; its source bitmap bars a source that may not be with one of those in it (``barred``:
    the bits of the sources barred by each source).
    """
    barred = barred or {}
    often = Counter(c for _, _, c in items)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    by_room: dict[int, list[int]] = {}
    rooms = 0
    clusters: list[int] = []
    sources: list[int] = []
    where = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        own, against = cluster_bit.get(cluster, 0), barred.get(source, 0)
        ahead, room, chosen, at = rooms >> size, 0, -1, -1
        while ahead:
            room = size + (ahead & -ahead).bit_length() - 1
            bins = by_room[room]
            if not own and not against:
                at = len(bins) - 1
            else:
                at = next((k for k in range(len(bins) - 1, -1, -1) if not clusters[bins[k]] & own and not sources[bins[k]] & against), -1)
            if at >= 0:
                chosen = bins.pop(at)
                if not bins:
                    rooms ^= 1 << room
                break
            ahead &= ahead - 1
        if chosen < 0:
            chosen, room = len(clusters), capacity
            clusters.append(0)
            sources.append(0)
        clusters[chosen] |= own
        sources[chosen] |= 1 << source
        left = room - size
        if left:
            by_room.setdefault(left, []).append(chosen)
            rooms |= 1 << left
        where[i] = chosen
    return where


def pack(sized: DataFrame, key: str, source: str, capacity: int, apart: Iterable[tuple[str, str]] = (), group_items: int = GROUP_ITEMS) -> DataFrame:
    """``sequence_id, key, piece, first_token, n_tokens``: one row a piece of an item.

    ``sized`` has ``key, source, n_tokens, cluster``. An item longer than ``capacity`` is cut into
    full pieces and a rest; no other is cut. A full piece is a sequence of its own. No sequence
    holds two items of one cluster, or of two sources named in ``apart``. Null sources are one
    source. Items of no tokens, or of a null size, are in no sequence. An empty table gives none.

    Items are spread over groups of about ``group_items`` by the hash of their key, each packed by
    one task; only the last sequences of a group are filled less, some 0.1 % of its tokens.
    """
    kind = sized.schema[key].dataType.simpleString()
    pairs = list(apart)
    whole = F.col("n_tokens")
    items = sized.where(whole > 0)
    groups = max(1, -(-items.count() // group_items))
    starts = F.sequence(F.lit(0), ((whole - 1) / capacity).cast("long"))
    pieces = (
        items.select(F.col(key).cast("string").alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source"), "cluster", "n_tokens", F.explode(starts).alias("piece"))
        .withColumn("first_token", F.col("piece") * capacity)
        .withColumn("size", F.least(F.lit(capacity), whole - F.col("first_token")))
        .withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))
    )

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_key", "piece"], na_position="first")
        names = {s: i for i, s in enumerate(sorted(set(frame["_source"])))}
        barred: dict[int, int] = {}
        for a, b in pairs:
            if a in names and b in names:
                barred[names[a]] = barred.get(names[a], 0) | 1 << names[b]
                barred[names[b]] = barred.get(names[b], 0) | 1 << names[a]
        where = best_fit(list(zip(frame["size"].tolist(), frame["_source"].map(names).tolist(), frame["cluster"].tolist(), strict=True)), capacity, barred)
        frame["sequence_id"] = [(int(g) << 40) + w for g, w in zip(frame["_group"], where, strict=True)]
        return frame[["sequence_id", "_key", "piece", "first_token", "size"]]

    packed = pieces.groupBy("_group").applyInPandas(place, "sequence_id long, _key string, piece long, first_token long, size long")
    return packed.select("sequence_id", F.col("_key").cast(kind).alias(key), "piece", "first_token", F.col("size").alias("n_tokens"))


def sequences(packed: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id, n_items, n_tokens, fill`` of each sequence."""
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / capacity, 6).alias("fill")
    )
