"""Numeric expressions: intervals, rates, distances, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
EARTH_KM = 6371.0088


def wilson(hits: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval of a share; null where total is 0."""
    n = F.when(total > 0, total.cast("double"))
    p, zz = hits / n, z * z
    middle, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (middle - spread) / (1 + zz / n), (middle + spread) / (1 + zz / n)


def verdict(low: Column, high: Column, bar: float = 0.8) -> Column:
    """pass if the whole interval is at the bar or above, fail if below, else undecided."""
    return F.when(low >= bar, "pass").when(high < bar, "fail").otherwise("undecided")


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    dlat, dlon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(dlat) ** 2 + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(dlon) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def match_score(matched: Column, asked: Column, shortfall: Column, unknown: Column, thin: float = 10.0, per_level: float = 15.0, per_unknown: float = 10.0) -> Column:
    """100 times the share of asked items that match, less penalties, at least 0; 0 where nothing is asked.

    Fewer than 5 asked items cost ``thin``, each level short costs ``per_level``, an unknown level less.
    """
    share = F.lit(100.0) * matched / F.when(asked > 0, asked)
    penalty = F.when(asked < 5, thin).otherwise(0.0) + F.coalesce(shortfall, F.lit(0)) * per_level + F.when(unknown, per_unknown).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), share - penalty), F.lit(0.0))


def coin(ident: Column, seed: int) -> Column:
    """A seeded coin: the order in which two answers are shown."""
    return F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(2)) == 1
