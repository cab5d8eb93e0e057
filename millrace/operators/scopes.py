"""Which records a pass reads, and how they are ranked for a question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(kind: Column, columns: Mapping[str, str]) -> Column:
    """The column that a record's kind has; null for kinds that have none."""
    value = F.lit(None).cast("string")
    for name, column in columns.items():
        value = F.when(kind == name, F.col(column)).otherwise(value)
    return value


def in_scope(state: Column, reason: Column, language: Column, reasons: Sequence[str], languages: Sequence[str]) -> Column:
    """Whether a record is in by its title, or undecided for one of the reasons in a language that can be read (null for unknown).

    Never null: what isn't known to hold doesn't.
    """
    readable = language.isNull() | F.lower(language).isin(*languages)
    return F.coalesce(state == "IN", F.lit(False)) | F.coalesce(reason.isin(*reasons) & readable, F.lit(False))


def ranked_by_items(df: DataFrame, ident: str, items: Column, asked: Sequence[str], published: str) -> DataFrame:
    """``df`` with ``n_met``, the number of asked items it has, in order: the most, then the newest, then the least id."""
    met = F.coalesce(F.size(F.array_intersect(items, F.array(*map(F.lit, asked)).cast("array<string>"))), F.lit(0))
    return df.withColumn("n_met", F.when(items.isNull(), 0).otherwise(met)).orderBy(F.desc("n_met"), F.desc_nulls_last(published), ident)


def find(df: DataFrame, wanted: Mapping[str, Column], published: str, rank: str, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Records that fulfil all conditions, the latest day first and in it the highest rank; and what hides others.

    A condition is null for a record that declares no value. The second result is one row: ``n_shown``,
    and for each condition ``hidden_<name>``, the records that fulfil all others and leave this one open.
    """
    names = list(wanted)
    judged = df.withColumns({f"_{n}": c for n, c in wanted.items()})
    held = {n: F.coalesce(F.col(f"_{n}"), F.lit(False)) for n in names}

    def every(skipped: str | None = None) -> Column:
        out = F.lit(True)
        for n in names:
            if n != skipped:
                out &= held[n]
        return out

    counts = judged.agg(F.count_if(every()).alias("n_shown"), *(F.count_if(every(n) & F.col(f"_{n}").isNull()).alias(f"hidden_{n}") for n in names))
    day = F.date_trunc("day", F.from_utc_timestamp(F.col(published), zone))
    return judged.where(every()).orderBy(F.desc_nulls_last(day), F.desc(rank)).select(*df.columns), counts
