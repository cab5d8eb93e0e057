"""Mirroring published records into held ones, and other ways to replace what is held."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.snapshots import row_hash


def reconcile(held: DataFrame, published: DataFrame, scope: str, key: str, compared: Sequence[str], outcome: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new table and a row ``scope, added, updated, deleted`` for each scope (a company, say).

    Records are matched by (scope, key), which must be unique on either side. Published ones are
    added or updated, held ones that aren't published go. ``outcome`` (``scope, outcome``) names the
    scopes that were read: those not ``published`` or ``not_found`` keep what is held, and a scope
    it lacks is one of them. Without it every scope counts as read. A null scope or key matches null.
    """
    names = [scope, key, *compared]
    h = held.select(*(F.col(c).alias(f"_h_{c}") for c in names), row_hash(compared).alias("_hh"))
    p = published.select(*(F.col(c).alias(f"_p_{c}") for c in names), row_hash(compared).alias("_ph"))
    on = F.col(f"_h_{scope}").eqNullSafe(F.col(f"_p_{scope}")) & F.col(f"_h_{key}").eqNullSafe(F.col(f"_p_{key}"))
    both = h.join(p, on, "full_outer").withColumn("_scope", F.coalesce(f"_h_{scope}", f"_p_{scope}"))
    read: Column = F.lit(True)
    if outcome is not None:
        seen = outcome.select(F.col(scope).alias("_oscope"), F.col("outcome").isin("published", "not_found").alias("_read")).dropDuplicates(["_oscope"])
        both = both.join(seen, F.col("_scope").eqNullSafe(F.col("_oscope")), "left")
        read = F.coalesce("_read", F.lit(False))
    new, gone = F.col("_hh").isNull(), F.col("_ph").isNull()
    state = F.when(~read, "kept").when(new, "added").when(gone, "deleted").when(F.col("_hh") != F.col("_ph"), "updated").otherwise("same")
    both = both.withColumn("_state", state).where(~((F.col("_state") == "kept") & new))
    take = F.col("_state").isin("added", "updated")
    table = both.where("_state <> 'deleted'").select(*(F.when(take, F.col(f"_p_{c}")).otherwise(F.col(f"_h_{c}")).alias(c) for c in names))
    report = both.groupBy(F.col("_scope").alias(scope)).agg(*(F.count_if(F.col("_state") == s).alias(s) for s in ("added", "updated", "deleted")))
    return table, report


def insert_absent(held: DataFrame, offered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is held, and of the offered rows those whose keys aren't; the first of equal keys by all columns."""
    fresh = offered.join(held.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return held.unionByName(fresh.select(*held.columns))


def record_outputs(corpus: DataFrame, outputs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The corpus with ``columns`` as the last run gave them; rows the run left out hold null."""
    return corpus.drop(*columns).join(outputs.select(key, *columns), key, "left")


def survivors(derived: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Derived rows whose parent is still there."""
    return derived.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def clear_dangling(rows: DataFrame, reference: str, ident: str) -> DataFrame:
    """Rows with ``reference`` set to null where no row has that id."""
    there = rows.select(F.col(ident).alias("_there")).distinct()
    return rows.join(there, F.col(reference) == F.col("_there"), "left").withColumn(reference, F.col("_there")).drop("_there").select(*rows.columns)


def commonest(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """``key, value, n``: the commonest value of each key that isn't blank; of equals the first by ``position``."""
    counts = df.where(F.trim(value) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_at"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("_at")).alias("early"), F.col(value).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(value), F.col("_b.n").alias("n"))


def tail_after(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """A keyset page: the first ``size`` rows in order of ``key`` after a given one."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)
