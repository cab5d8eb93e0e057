"""Boards' documents made from openings and read again, with the openings as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.html import html_structure
from millrace.sources import boards
from millrace.sources.tables import table


def _openings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vacancy", "id", "company_id", "external_id", "title", "location", "department", "description", "url", "pay_min_cents", "pay_max_cents", "pay_currency", "pay_interval", "first_published_at")


def _escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _html(text: Column) -> Column:
    """A paragraph a line."""
    return F.array_join(F.transform(F.split(_escaped(text), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")


def _read(df: DataFrame) -> DataFrame:
    return df.select(
        "company_id", "external_id", "title", "location", "department", "url", "pay_min_cents", "pay_max_cents", "pay_currency", F.unix_millis("published_at").alias("published_ms"),
        F.length("description").alias("n_chars"), F.md5(F.col("description").cast("binary")).alias("digest"),
    )


_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def listed_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings through documents with ``jobs[]``, escaped HTML and pay in cents."""
    job = F.struct(
        F.col("external_id").alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"), F.array(F.struct(F.col("department").alias("name"))).alias("departments"),
        _escaped(_html(F.col("description"))).alias("content"), F.col("url").alias("absolute_url"), F.date_format("first_published_at", _TIME).alias("first_published"),
        F.array(F.struct(F.col("pay_min_cents").alias("min_cents"), F.col("pay_max_cents").alias("max_cents"), F.col("pay_currency").alias("currency_type"))).alias("pay_input_ranges"),
    )
    return _read(boards.listed_board(_openings(spark, d).select("company_id", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"))))


def component_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings through documents with compensation by components."""
    pay = F.struct(F.lit("Salary").alias("compensationType"), F.col("pay_interval").alias("interval"), F.col("pay_currency").alias("currencyCode"), (F.col("pay_min_cents") / 100).alias("minValue"), (F.col("pay_max_cents") / 100).alias("maxValue"))
    equity = F.struct(*(F.lit(x).cast(k).alias(n) for n, x, k in (("compensationType", "Equity", "string"), ("interval", None, "string"), ("currencyCode", "XXX", "string"), ("minValue", 1, "double"), ("maxValue", None, "double"))))
    job = F.struct(
        F.col("external_id").alias("id"), "title", "location", "department", _html(F.col("description")).alias("descriptionHtml"), F.col("url").alias("jobUrl"),
        F.date_format("first_published_at", _TIME).alias("publishedAt"), F.struct(F.array(equity, pay).alias("summaryComponents")).alias("compensation"),
    )
    return _read(boards.component_board(_openings(spark, d).select("company_id", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"))))


def section_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings through arrays of openings whose description is their first section."""
    job = F.struct(
        F.col("external_id").alias("id"), F.col("title").alias("text"), F.struct("location", "department").alias("categories"), _html(F.col("description")).alias("description"), F.array().cast("array<struct<text:string,content:string>>").alias("lists"),
        F.col("url").alias("hostedUrl"), F.unix_millis("first_published_at").alias("createdAt"), F.struct((F.col("pay_min_cents") / 100).alias("min"), (F.col("pay_max_cents") / 100).alias("max"), F.col("pay_currency").alias("currency")).alias("salaryRange"),
    )
    return _read(boards.section_board(_openings(spark, d).select("company_id", F.to_json(F.array(job)).alias("body"))))


def html_outline(spark: SparkSession, d: str) -> DataFrame:
    """Lines and items of descriptions written as HTML, an item a line that begins with a hyphen."""
    lines = F.transform(F.split(_escaped(F.col("description")), "\n"), lambda x: F.when(x.startswith("- "), F.concat(F.lit("<ul><li>"), F.substr(x, F.lit(3)), F.lit("</li></ul>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    rows = _openings(spark, d).dropDuplicates(["id"]).where("description is not null").select("id", html_structure(F.array_join(lines, "")).alias("s"))
    return rows.select("id", "s.n_lines", "s.n_items")


QUERIES = {f.__name__: f for f in (listed_openings, component_openings, section_openings, html_outline)}

_LINES = r"list_filter(list_transform(string_split(description, chr(10)), lambda x: regexp_replace(trim(regexp_replace(x, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{1680}\x{0085}\x{2028}\x{2029}]+', ' ', 'g')), '^[># ]*([>#])?[># ]*', '')), lambda x: x <> '')"
_READ = rf"""WITH t AS (SELECT *, first_published_at AS f, nullif(array_to_string({_LINES}, chr(10)), '') AS t FROM vacancy)
    SELECT company_id, external_id, title, location, department, url, pay_min_cents, pay_max_cents, pay_currency, epoch_ms(f) AS published_ms, length(t) AS n_chars, md5(t) AS digest FROM t"""

ORACLES = {
    "listed_openings": _READ, "component_openings": _READ, "section_openings": _READ,
    "html_outline": r"""WITH v AS (SELECT id, any_value(description) AS description FROM vacancy GROUP BY id), l AS (SELECT id, unnest(string_split(description, chr(10))) AS line FROM v WHERE description IS NOT NULL)
        SELECT id, count(*) FILTER (trim(regexp_replace(line, '^- ', '')) <> '')::INT AS n_lines, count(*) FILTER (starts_with(line, '- ') AND trim(line[3:]) <> '')::INT AS n_items FROM l GROUP BY id""",
}
