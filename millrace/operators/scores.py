"""Scores of results against labelled rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIGHT, COARSER, WRONG = "right", "coarser", "wrong"


def levels_agreement(expected: Sequence[Column], found: Sequence[Column]) -> Column:
    """How a found value agrees with an expected one, both given by levels from the widest to the finest.

    ``right`` if all levels are equal, ``coarser`` if the found one ends earlier and is equal so far
    (with one level at least), else ``wrong``. A null level ends a value.
    """
    same, coarser = F.lit(True), F.lit(False)
    for i, (e, f) in enumerate(zip(expected, found, strict=True)):
        if i:
            coarser |= same & f.isNull() & e.isNotNull()
        same &= e.eqNullSafe(f)
    return F.when(same, RIGHT).when(coarser, COARSER).otherwise(WRONG)


def hierarchical_scores(expected: DataFrame, found: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """One row ``n_found, right, coarser, wrong, n_expected, recalled, precision, recall``.

    Each distinct found row has the best agreement with any expected row of its key; an expected row is
    recalled if a found one is right. ``precision`` counts right and coarser ones. A key on one side
    only gives wrong or unrecalled rows. Both shares are null without rows.
    """
    names = [key, *levels]
    e = expected.select(*(F.col(c).alias(f"_e{i}") for i, c in enumerate(names))).distinct()
    f = found.select(*(F.col(c).alias(f"_f{i}") for i, c in enumerate(names))).distinct()
    met = f.join(e, F.col("_f0").eqNullSafe(F.col("_e0")), "left").withColumn("_there", F.col("_e1").isNotNull())
    rank = {RIGHT: 2, COARSER: 1, WRONG: 0}
    agreement = levels_agreement([F.col(f"_e{i}") for i in range(1, len(names))], [F.col(f"_f{i}") for i in range(1, len(names))])
    best = met.withColumn("_a", F.when(F.col("_there"), F.when(agreement == RIGHT, rank[RIGHT]).when(agreement == COARSER, rank[COARSER]).otherwise(0)).otherwise(0))
    each = best.groupBy(*(f"_f{i}" for i in range(len(names)))).agg(F.max("_a").alias("_a"))
    totals = each.agg(F.count(F.lit(1)).alias("n_found"), *(F.count_if(F.col("_a") == n).alias(k) for k, n in rank.items()))
    same = [F.col(f"_e{i}").eqNullSafe(F.col(f"_f{i}")) for i in range(len(names))]
    on = same[0]
    for x in same[1:]:
        on &= x
    recalled = e.join(f, on, "left_semi").agg(F.count(F.lit(1)).alias("recalled"))
    there = e.agg(F.count(F.lit(1)).alias("n_expected"))
    row = totals.select("*", there.scalar().alias("n_expected"), recalled.scalar().alias("recalled"))
    return row.withColumn("precision", F.try_divide(F.col("right") + F.col("coarser"), F.col("n_found"))).withColumn("recall", F.try_divide("recalled", "n_expected"))


def stratified_share(labels: DataFrame, stratum: str, hit: str, sizes: DataFrame) -> DataFrame:
    """One row ``share, error, reach``: the share of hits estimated from a stratified sample.

    ``sizes`` has ``stratum, size``. Each judged stratum counts by its size; ``error`` is the standard
    error (a stratum of one label adds none) and ``reach`` the estimated number of hits. Labels without
    an answer don't count, strata without labels are left out of the total.
    """
    judged = labels.where(F.col(hit).isNotNull()).groupBy(F.col(stratum).alias("_of")).agg(F.avg(F.col(hit).cast("double")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    both = judged.join(sizes.select(F.col(stratum).alias("_stratum"), F.col("size").cast("double").alias("_s")), F.col("_of") == F.col("_stratum"))
    spread = F.when(F.col("_n") > 1, F.col("_s") ** 2 * F.col("_p") * (1 - F.col("_p")) / (F.col("_n") - 1)).otherwise(0.0)
    total = F.nullif(F.sum("_s"), F.lit(0.0))
    reach = F.sum(F.col("_p") * F.col("_s"))
    return both.agg((reach / total).alias("share"), (F.sqrt(F.sum(spread)) / total).alias("error"), reach.alias("reach"))


def pair_recall(labelled: DataFrame, found: DataFrame, a: str, b: str, same: str) -> DataFrame:
    """One row ``true_pairs, found_pairs, false_found, recall``: labelled pairs against found ones, in either order."""
    def unordered(df: DataFrame, *more: str) -> DataFrame:
        return df.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), *more)

    hits = unordered(found).distinct().withColumn("_hit", F.lit(True))
    both = unordered(labelled, same).distinct().join(hits, ["_a", "_b"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    counted = both.agg(F.count_if(same).alias("true_pairs"), F.count_if(F.col(same) & hit).alias("found_pairs"), F.count_if(~F.col(same) & hit).alias("false_found"))
    return counted.withColumn("recall", F.try_divide("found_pairs", "true_pairs"))


def commonest_sets(df: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """``items, n_keys``: the ``n`` commonest sets of items that a key states, in the order of frequency, then of the items.

    Nulls are no items; a key with none has the empty set. The sets of one key are bounded by its items.
    """
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.groupBy("items").agg(F.count(F.lit(1)).alias("n_keys")).orderBy(F.desc("n_keys"), F.array_join(F.transform("items", lambda x: x.cast("string")), "\n")).limit(n)


def within_ceilings(expected: DataFrame, found: DataFrame, key: str, label: str, ceilings: Mapping[str, int]) -> DataFrame:
    """``label, n_expected, n_wrong, within``: of each expected label how many rows are found otherwise, and whether that is allowed.

    A label without a ceiling allows none. A key that isn't found is wrong.
    """
    f = found.select(F.col(key).alias("_k"), F.col(label).alias("_found")).dropDuplicates(["_k"])
    both = expected.join(f, F.col(key) == F.col("_k"), "left")
    allowed = F.coalesce(F.create_map(*(F.lit(x) for pair in ceilings.items() for x in pair))[F.col(label)], F.lit(0)) if ceilings else F.lit(0)
    counted = both.groupBy(label).agg(F.count(F.lit(1)).alias("n_expected"), F.count_if(~F.col(label).eqNullSafe(F.col("_found"))).alias("n_wrong"))
    return counted.withColumn("within", F.col("n_wrong") <= allowed)
