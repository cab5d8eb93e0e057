"""Reference lists from tab-separated files, checked as they are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import name_form


def tsv(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """Rows of a tab-separated file as strings; a missing last field is empty, blank lines are dropped, quotes mean nothing."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.csv(path, schema=schema, sep="\t", header=header, quote="", escape="", mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    blank = F.concat_ws("", *columns).rlike(r"^\s*$")
    return rows.where(~blank).select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def refuse(rows: DataFrame, what: str) -> None:
    """Raise if there are rows; the first few are named."""
    bad = rows.limit(3).collect()
    if bad:
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")


def listed(value: Column) -> Column:
    """The parts of a field between bars, without empty ones."""
    return F.filter(F.split(value, r"\|"), lambda x: x != "")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, category, aliases, context_keys, parent`` of a list without a header.

    Refused: an id given twice, a parent that isn't listed, and a key (name or alias) of two entries.
    """
    raw = tsv(spark, path, ["id", "name", "category", "aliases", "context_keys", "parent"], header=False)
    rows = raw.select("id", "name", "category", listed(F.col("aliases")).alias("aliases"), listed(F.col("context_keys")).alias("context_keys"), F.nullif("parent", F.lit("")).alias("parent"))
    refuse(rows.groupBy("id").count().where("count > 1"), "ids given twice")
    refuse(rows.where("parent is not null").join(rows.select(F.col("id").alias("_id")), F.col("parent") == F.col("_id"), "left_anti").select("id", "parent"), "parents not listed")
    keys = rows.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("key")).select("id", name_form(F.col("key")).alias("key"))
    refuse(keys.distinct().groupBy("key").count().where("count > 1"), "keys of two entries")
    return rows


def phrase_roles(words: DataFrame, roles: DataFrame) -> DataFrame:
    """``phrase, use, role`` with each phrase once a use and only roles that are listed."""
    refuse(words.groupBy("phrase", "use").count().where("count > 1"), "phrases given twice for a use")
    refuse(words.where("role <> ''").join(roles.select(F.col("slug").alias("role")), "role", "left_anti").select("phrase", "role"), "roles not listed")
    return words.select("phrase", "use", F.nullif("role", F.lit("")).alias("role"))


def region_countries(regions: DataFrame, countries: DataFrame) -> DataFrame:
    """``region, country`` with ``*`` expanded to every country; a country that isn't listed is refused."""
    codes = countries.select(F.col("code").alias("country")).distinct()
    named = regions.where("country <> '*'")
    refuse(named.join(codes, "country", "left_anti").select("region", "country"), "countries not listed")
    everywhere = regions.where("country = '*'").select("region").distinct().withColumn("_one", F.lit(1)).join(codes.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return named.select("region", "country").unionByName(everywhere).distinct()


def offset_minutes(hours: Column) -> Column:
    return F.round(hours.cast("double") * 60).cast("int")


def unread_boards(spark: SparkSession, path: str) -> DataFrame:
    """``ats, slug, reason`` of boards not to be read; blank fields and boards given twice are refused."""
    rows = tsv(spark, path, ["ats", "slug", "reason"])
    refuse(rows.where(F.exists(F.array("ats", "slug", "reason"), lambda x: F.trim(x) == "")), "blank fields")
    refuse(rows.groupBy("ats", "slug").count().where("count > 1"), "boards given twice")
    return rows
