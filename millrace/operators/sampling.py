"""Seeded samples, their allocation, and what is estimated from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(ident: str, seed: int) -> Column:
    return F.xxhash64(F.col(ident), F.lit(seed))


def largest_remainder(sizes: DataFrame, stratum: str, size: str, total: int) -> DataFrame:
    """``stratum, size, drawn``: ``total`` shared out by size; what the floors leave goes to the largest remainders.

    Equal remainders go by name. The largest are found by a distributed top-k, so strata may be many.
    """
    everything = sizes.agg(F.sum(size)).scalar()
    share = sizes.select(stratum, size, (F.col(size) * F.lit(total) / everything).alias("_exact")).withColumn("_floor", F.floor("_exact"))
    left = total - (share.agg(F.sum("_floor")).first()[0] or 0)
    more = share.where("_exact is not null").orderBy(F.desc(F.col("_exact") - F.col("_floor")), stratum).limit(left).select(F.col(stratum).alias("_more"))
    joined = share.join(more, F.col(stratum).eqNullSafe(F.col("_more")) & F.col(stratum).isNotNull(), "left")
    return joined.select(stratum, size, (F.col("_floor") + F.col("_more").isNotNull().cast("int")).alias("drawn"))


def stratified_sample(df: DataFrame, stratum: str, ident: str, per_stratum: int, seed: int) -> DataFrame:
    """The first ``per_stratum`` rows of each stratum in seeded order; a smaller draw is the beginning of a larger one.

    A task keeps only its own first rows of a stratum before the shuffle, so a large stratum is not
    gathered.
    """
    order = draw_order(ident, seed)
    salted = Window.partitionBy(stratum, "_salt").orderBy("_order", ident)
    first = df.withColumn("_order", order).withColumn("_salt", F.spark_partition_id()).withColumn("_in", F.row_number().over(salted)).where(F.col("_in") <= per_stratum)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_order", ident))
    return first.withColumn("drawn", rank).where(F.col("drawn") <= per_stratum).drop("_order", "_salt", "_in")


def precision_by_cell(labels: DataFrame, cell: str, answer: str, weight: DataFrame | None = None) -> DataFrame:
    """``cell, right, judged, precision`` without unclear answers, and a row of null cell over all cells.

    With ``weight`` (``cell, size``) that row's precision is the mean weighted by cell size.
    """
    counted = labels.where(F.col(answer) != "unclear")
    cells = counted.groupBy(cell).agg(F.count_if(F.col(answer) == "right").alias("right"), F.count(F.lit(1)).alias("judged"))
    cells = cells.withColumn("precision", F.try_divide("right", "judged"))
    both = cells if weight is None else cells.join(weight.withColumnRenamed("size", "_size"), cell)
    mean = F.try_divide(F.sum("right"), F.sum("judged")) if weight is None else F.try_divide(F.sum(F.col("precision") * F.col("_size")), F.sum("_size"))
    overall = both.agg(F.sum("right").alias("right"), F.sum("judged").alias("judged"), mean.alias("precision"))
    return cells.unionByName(overall.select(F.lit(None).cast(cells.schema[cell].dataType).alias(cell), "right", "judged", "precision"))


def bootstrap_interval(df: DataFrame, value: str, resamples: int, seed: int, levels: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """``low, high``: percentiles of the mean over seeded resamples, each row drawn a Poisson number of times.

    Poisson counts stand for draws with replacement. Those of n equal values sum to a Poisson number of
    mean n, so the rows are first counted by value and all resamples of a value are drawn as one array,
    seeded by it: the result depends on the values and the seed, not on how they are partitioned. Each
    task adds up one array of weights and one of weighted values. Nulls don't count; without values
    both bounds are null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, weighted = np.zeros(resamples), np.zeros(resamples)
        for frame in frames:
            for v, n in zip(frame["v"].tolist(), frame["n"].tolist(), strict=True):
                drawn = np.random.default_rng([seed, *np.frombuffer(np.float64(v).tobytes(), np.uint32)]).poisson(n, resamples)
                weight += drawn
                weighted += drawn * v
        yield pd.DataFrame({"r": range(resamples), "w": weight, "wv": weighted})

    sums = counts.mapInPandas(draw, "r int, w double, wv double").groupBy("r").agg((F.sum("wv") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    mean = F.round("m", 9)  # sums of doubles differ in their last places with the order of the tasks
    return sums.agg(F.percentile(mean, levels[0]).alias("low"), F.percentile(mean, levels[1]).alias("high"))


def confusion(df: DataFrame, expected: str, found: str, states: Sequence[str]) -> DataFrame:
    """A row for each expected state, with the number of each found one."""
    return df.groupBy(expected).pivot(found, list(states)).agg(F.count(F.lit(1))).na.fill(0)


def label_differences(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted, with ``side`` missing or extra."""
    missing, extra = expected.exceptAll(given), given.exceptAll(expected)
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))
