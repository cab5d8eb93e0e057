"""Sources mixed to target shares of a token budget."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of budget that the dynamic program fits exactly; what is above it is filled in proportion.
EXACT_TOKENS = 1 << 16
_PARTS = 256


def fit_counts(available: dict[int, int], budget: int) -> dict[int, int]:
    """How many items to take of each size, so that they come as close to ``budget`` as can be from below.

    Sizes are taken in proportion first, then from the largest on, until the rest of the budget is
    below EXACT_TOKENS; a bounded knapsack over the sizes left fits that rest. Its state is one bit
    for each reachable sum.
    """
    sizes = sorted((s for s in available if s > 0), reverse=True)
    total = sum(s * available[s] for s in sizes)
    if total <= budget:
        return {s: available[s] for s in sizes}
    take = {s: available[s] * budget // total for s in sizes}
    rest = budget - sum(s * n for s, n in take.items())
    for s in sizes:
        more = min(available[s] - take[s], max(0, rest - EXACT_TOKENS) // s)
        take[s] += more
        rest -= more * s
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for s in sizes:
        left, some = available[s] - take[s], 1
        while left > 0 and s * some <= rest and not reach >> rest & 1:
            some = min(some, left)
            steps.append((s, some, reach))
            reach |= reach << (s * some) & mask
            left -= some
            some *= 2
    best = reach.bit_length() - 1
    for s, some, before in reversed(steps):
        if not before >> best & 1:
            take[s] += some
            best -= s * some
    return take


def mixture_plan(sized: DataFrame, source: str, targets: DataFrame, budget_share: float) -> DataFrame:
    """What each source gives, a row for each of its sizes.

    Returns ``source, n_tokens, n_all, n_extra, passes, target_tokens, short``: of the ``n_all``
    documents of ``n_tokens`` tokens, ``n_extra`` are used ``passes + 1`` times and the rest
    ``passes`` times. ``targets`` has ``source, weight, max_repeats``. A source's target is its
    share of the weights times ``budget_share`` of the tokens of all documents; ``short`` tells
    that its documents, all used max_repeats times, hold fewer. A source without documents has one
    row of nulls and is short unless its target is 0. Null weights and repeats are 0; documents of a
    source without a target, and of no tokens, are in no mixture.

    The documents are counted by size first, so one task gets the sizes of a source, not its documents.
    """
    sizes = sized.where("n_tokens > 0").groupBy(F.col(source).alias("_source"), "n_tokens").agg(F.count(F.lit(1)).alias("n_all"))
    every = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).scalar()
    clean = targets.groupBy(F.col("source").alias("source")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    weights = clean.agg(F.sum("weight")).scalar()
    wanted = clean.withColumn("target_tokens", F.col("weight") / weights * F.lit(budget_share) * every)
    joined = wanted.join(sizes, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "max_repeats", "target_tokens", "n_tokens", "n_all")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        target, repeats = float(frame["target_tokens"].iloc[0]), int(frame["max_repeats"].iloc[0])
        held = frame.dropna(subset=["n_tokens"])
        available = {int(s): int(n) for s, n in zip(held["n_tokens"], held["n_all"], strict=True)}
        total = sum(s * n for s, n in available.items())
        short = total * repeats < target
        if short or not total:
            passes, extra = repeats, {}
        else:
            passes = min(int(target // total), repeats)
            extra = fit_counts(available, math.floor(target) - passes * total) if passes < repeats else {}
        out = frame[["source", "n_tokens", "n_all", "target_tokens"]].copy()
        out["n_extra"] = [extra.get(int(s), 0) if s == s and s is not None else None for s in out["n_tokens"].astype(object)]
        out["passes"], out["short"] = passes, short
        return out.astype({"n_tokens": "Int64", "n_all": "Int64", "n_extra": "Int64"})[["source", "n_tokens", "n_all", "n_extra", "passes", "target_tokens", "short"]]

    schema = "source string, n_tokens long, n_all long, n_extra long, passes int, target_tokens double, short boolean"
    return joined.groupBy("source").applyInPandas(fit, schema)


def _seeded(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def mixture(sized: DataFrame, key: str, source: str, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``key, source, n_tokens, repeats``: the documents of the mixture, each used at least once.

    Of the documents of a source and size the ones with the least seeded hash are used once more.
    Their ranks come from counts of 256 parts of the hash range and the rank within a part, so one
    size that many documents share isn't ordered by one task.
    """
    rows = sized.where("n_tokens > 0").select(F.col(key).alias("_key"), F.col(source).alias("_source"), "n_tokens", _seeded(key, seed).alias("_h"))
    rows = rows.withColumn("_part", F.shiftright(F.col("_h"), 56))
    before = Window.partitionBy("_source", "n_tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_source", "n_tokens", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "n_tokens", "_part").orderBy("_h", "_key")))
    a, b = within.alias("a"), counts.alias("b")
    same = F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a.n_tokens") == F.col("b.n_tokens")) & (F.col("a._part") == F.col("b._part"))
    ranked = a.join(b, same).select("a._key", "a._source", "a.n_tokens", (F.col("a._in") + F.col("b._before")).alias("_rank"))
    wanted = plan.where("n_tokens is not null").select(F.col("source").alias("_psource"), F.col("n_tokens").alias("_ptokens"), "n_extra", "passes")
    used = ranked.join(wanted, F.col("_source").eqNullSafe(F.col("_psource")) & (F.col("n_tokens") == F.col("_ptokens")))
    repeats = F.col("passes") + F.when(F.col("_rank") <= F.col("n_extra"), 1).otherwise(0)
    return used.select(F.col("_key").alias(key), F.col("_source").alias(source), "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def mixture_shares(plan: DataFrame) -> DataFrame:
    """``source, target_tokens, actual_tokens, target_share, actual_share, short`` of each source."""
    used = F.col("n_tokens") * (F.col("n_all") * F.col("passes") + F.col("n_extra"))
    by_source = plan.groupBy("source").agg(F.max("target_tokens").alias("target_tokens"), F.coalesce(F.sum(used), F.lit(0)).alias("actual_tokens"), F.max("short").alias("short"))
    targets, actual = by_source.agg(F.sum("target_tokens")).scalar(), by_source.agg(F.sum("actual_tokens")).scalar()
    share = lambda part, whole: F.round(F.try_divide(F.col(part), whole), 6)
    return by_source.select(
        "source", F.round("target_tokens", 3).alias("target_tokens"), "actual_tokens", share("target_tokens", targets).alias("target_share"),
        share("actual_tokens", actual).alias("actual_share"), "short",
    )
