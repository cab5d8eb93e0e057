"""Queries of the general problems over the recruiting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.heavy_keys import heavy_keys, key_profile
from millrace.operators.packed import holds_delimiter, split_by_lists
from millrace.operators.snapshots import plain_key, snapshot_changes
from millrace.sources.tables import table

HEAVY_SHARE = 0.025
COMPARED = ["title", "location", "department", "pay_min_cents", "description_hash"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "vacancy", "company_id"), "company_id", HEAVY_SHARE).select("company_id")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vacancy", "company_id", "id", "updated_at")
    return key_profile(rows, "company_id", "id", "updated_at").select(
        "company_id", "n_rows", F.col("n_items").alias("n_openings"), "n_duplicates", F.unix_micros("latest_update").alias("latest_update_us")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    snapshots = table(spark, d, "vacancy_snapshot", "snapshot_no", "company_id", "external_id", "updated_at", *COMPARED)
    keys = {"company_id": F.col("company_id"), "plain_id": plain_key(F.col("external_id"))}
    changes = snapshot_changes(snapshots, "snapshot_no", keys, COMPARED, "updated_at")
    written = (
        table(spark, d, "vacancy", "company_id", "external_id")
        .groupBy(F.col("company_id").alias("_c"), plain_key(F.col("external_id")).alias("_p"))
        .agg(F.min("external_id").alias("external_id"))
    )
    on = F.col("company_id").eqNullSafe(F.col("_c")) & F.col("plain_id").eqNullSafe(F.col("_p"))
    return changes.join(written, on, "left").select("snapshot_no", "company_id", F.coalesce("external_id", "plain_id").alias("external_id"), "change_kind")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_changes"))


def place_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The words that follow a place name, and the names that hold a delimiter."""
    places = table(spark, d, "place", "name", "country", "country_name", "subdivision")
    words = places.select(F.explode(F.array("country", "country_name", "subdivision")).alias("word")).where("word is not null")
    return words, places.select("name").where(holds_delimiter(F.col("name")))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "vacancy", "id", "location").dropDuplicates(["id"])
    return split_by_lists(once, "id", "location", *place_words(spark, d)).select(
        F.col("id").alias("vacancy_id"), "pos", F.col("value").alias("loc_value"), "n_values"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_values(spark, d).where("n_values > 1").select("vacancy_id", "pos", "loc_value")


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p2_found": p2_found, "p2_totals": p2_totals, "p3_found": p3_found}

_PLAIN = r"""CASE WHEN regexp_full_match(lower(trim({0}, chr(9) || chr(10) || chr(13) || ' ')), '[0-9]+')
  THEN regexp_replace(lower(trim({0}, chr(9) || chr(10) || chr(13) || ' ')), '^0+([0-9])', '\1')
  ELSE lower(trim({0}, chr(9) || chr(10) || chr(13) || ' ')) END"""

_CHANGES = f"""
WITH s AS (
  SELECT snapshot_no, company_id, {_PLAIN.format('external_id')} AS k, updated_at,
         title, location, department, pay_min_cents, description_hash
  FROM vacancy_snapshot),
one AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY snapshot_no, company_id, k ORDER BY updated_at DESC NULLS LAST) = 1),
pair AS (
  SELECT coalesce(a.snapshot_no, b.snapshot_no + 1) AS snapshot_no, coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.k, b.k) AS k,
         CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed'
              WHEN (a.title, a.location, a.department, a.pay_min_cents, a.description_hash)
                   IS DISTINCT FROM (b.title, b.location, b.department, b.pay_min_cents, b.description_hash) THEN 'changed' END AS change_kind
  FROM one a FULL JOIN one b ON a.company_id = b.company_id AND a.k = b.k AND a.snapshot_no = b.snapshot_no + 1),
w AS (SELECT company_id, {_PLAIN.format('external_id')} AS k, min(external_id) AS external_id FROM vacancy GROUP BY ALL),
found AS (
  SELECT p.snapshot_no, p.company_id, coalesce(w.external_id, p.k) AS external_id, p.change_kind
  FROM pair p LEFT JOIN w ON w.company_id = p.company_id AND w.k = p.k
  WHERE p.change_kind IS NOT NULL AND p.snapshot_no BETWEEN 2 AND (SELECT max(snapshot_no) FROM vacancy_snapshot))
"""

ORACLES = {
    "p1_found": "SELECT company_id FROM vacancy GROUP BY company_id HAVING count(*) >= 0.025 * (SELECT count(*) FROM vacancy) AND company_id IS NOT NULL",
    "p1_profile": """SELECT company_id, count(*) AS n_rows, count(DISTINCT id) AS n_openings,
        count(*) - count(DISTINCT id) AS n_duplicates, epoch_us(max(updated_at)) AS latest_update_us FROM vacancy GROUP BY company_id""",
    "p2_found": _CHANGES + "SELECT * FROM found",
    "p2_totals": _CHANGES + "SELECT snapshot_no, change_kind, count(*) AS n_changes FROM found GROUP BY ALL",
}
