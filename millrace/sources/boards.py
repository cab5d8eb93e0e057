"""Boards' JSON documents as one shape of record.

Each reader takes a frame of ``company_id, body`` (a board's document) and gives a row an opening.
Bodies that don't parse give no rows; ``unreadable`` finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import html_to_lines

COLUMNS = ["company_id", "external_id", "title", "location", "secondary_locations", "department", "description", "url", "pay_min_cents", "pay_max_cents", "pay_currency", "pay_interval", "published_at", "language"]

_LISTED = "jobs array<struct<id:string,title:string,location:struct<name:string>,departments:array<struct<name:string>>,content:string,absolute_url:string,updated_at:string,first_published:string,language:string,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string>>>>"
_COMPONENTS = "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,descriptionHtml:string,jobUrl:string,publishedAt:string,compensation:struct<summaryComponents:array<struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>>>>>"
_SECTIONS = "array<struct<id:string,text:string,categories:struct<location:string,allLocations:array<string>,department:string>,description:string,lists:array<struct<text:string,content:string>>,additional:string,hostedUrl:string,createdAt:bigint,salaryRange:struct<min:double,max:double,currency:string,interval:string>>>"


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def unescaped(html: Column) -> Column:
    """HTML whose signs were written as entities once more."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(sign))
    return html


def _shape(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"secondary_locations": "array<string>", "pay_min_cents": "long", "pay_max_cents": "long", "published_at": "timestamp"}
    return df.select("company_id", *(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS[1:]))


def listed_board(boards: DataFrame) -> DataFrame:
    """Boards with ``jobs[]``, a named location, escaped HTML and pay ranges in cents, of which the first counts."""
    j = boards.select("company_id", F.explode(F.from_json("body", _LISTED)["jobs"]).alias("j"))
    pay = F.get(F.col("j.pay_input_ranges"), F.lit(0))
    return _shape(
        j, external_id=F.col("j.id"), title=F.col("j.title"), location=F.col("j.location.name"), department=F.get(F.col("j.departments"), F.lit(0))["name"],
        description=html_to_lines(unescaped(F.col("j.content"))), url=F.col("j.absolute_url"), pay_min_cents=pay["min_cents"], pay_max_cents=pay["max_cents"], pay_currency=pay["currency_type"],
        published_at=F.try_to_timestamp(F.coalesce("j.first_published", "j.updated_at")), language=F.col("j.language"),
    )


def component_board(boards: DataFrame) -> DataFrame:
    """Boards with secondary locations and compensation by components, of which the salary counts."""
    j = boards.select("company_id", F.explode(F.from_json("body", _COMPONENTS)["jobs"]).alias("j"))
    pay = F.get(F.filter(F.col("j.compensation.summaryComponents"), lambda c: c["compensationType"] == "Salary"), F.lit(0))
    return _shape(
        j, external_id=F.col("j.id"), title=F.col("j.title"), location=F.col("j.location"), secondary_locations=F.transform("j.secondaryLocations", lambda x: x["location"]),
        department=F.col("j.department"), description=html_to_lines(F.col("j.descriptionHtml")), url=F.col("j.jobUrl"), pay_min_cents=cents(pay["minValue"]), pay_max_cents=cents(pay["maxValue"]),
        pay_currency=pay["currencyCode"], pay_interval=pay["interval"], published_at=F.try_to_timestamp("j.publishedAt"),
    )


def section_board(boards: DataFrame) -> DataFrame:
    """Boards that are an array, with a description in sections: text, headed lists and a closing."""
    j = boards.select("company_id", F.explode(F.from_json("body", _SECTIONS)).alias("j"))
    lists = F.transform("j.lists", lambda x: F.concat(F.lit("<h3>"), x["text"], F.lit("</h3><ul>"), x["content"], F.lit("</ul>")))
    html = F.concat_ws("", F.col("j.description"), F.array_join(lists, ""), F.col("j.additional"))
    return _shape(
        j, external_id=F.col("j.id"), title=F.col("j.text"), location=F.col("j.categories.location"), secondary_locations=F.col("j.categories.allLocations"), department=F.col("j.categories.department"),
        description=html_to_lines(html), url=F.col("j.hostedUrl"), pay_min_cents=cents(F.col("j.salaryRange.min")), pay_max_cents=cents(F.col("j.salaryRange.max")),
        pay_currency=F.col("j.salaryRange.currency"), pay_interval=F.col("j.salaryRange.interval"), published_at=F.timestamp_millis("j.createdAt"),
    )


def unreadable(boards: DataFrame) -> DataFrame:
    """Boards whose body is no JSON object or array."""
    return boards.where(F.try_parse_json("body").isNull() | ~F.ltrim("body").rlike(r"^[\[{]")).select("company_id")


def declared_locations(location: Column, secondary: Column, every: Column) -> Column:
    """All places an opening declares: its location unless blank, the secondary ones, and all others, whose first is left out if it repeats the location."""
    first = F.when(F.trim(location) != "", F.array(location)).otherwise(F.array().cast("array<string>"))
    rest = F.filter(F.coalesce(every, F.array().cast("array<string>")), lambda x, i: (i > 0) | ~x.eqNullSafe(location))
    return F.concat(first, F.coalesce(secondary, F.array().cast("array<string>")), rest)


def covering_facet(facets: DataFrame, total: int, page: int = 20, within: float = 0.01) -> DataFrame:
    """The facet by which a listing capped at its total is read: its values' counts sum up to the total, in the fewest pages.

    ``facets`` has ``facet, value, n``. Gives ``facet, value, n`` of that facet; none if no facet covers.
    """
    sums = facets.groupBy("facet").agg(F.sum("n").alias("_n"), F.sum(F.ceil(F.col("n") / page)).alias("_pages"))
    best = sums.where(F.abs(F.col("_n") - total) <= within * total).agg(F.min(F.struct("_pages", "facet"))["facet"].alias("facet")).where("facet is not null")
    return facets.join(best, "facet")


def complete(read: DataFrame, key: str, total: int, least: float = 0.9) -> DataFrame:
    """``n_read, complete``: distinct records read, and whether they are enough of the total to count as the board."""
    return read.agg(F.count_distinct(key).alias("n_read")).withColumn("complete", F.col("n_read") >= least * total)


def details_wanted(listed: DataFrame, held: DataFrame, wanted: Column, key: str = "external_id") -> DataFrame:
    """Listed openings whose detail page is to be read: those ``wanted`` that aren't held under the same key and title."""
    return listed.where(wanted).join(held.select(key, "title"), [key, "title"], "left_anti")


def probed(answers: DataFrame, list_path: str = "$.jobs", name_path: str = "$.name") -> DataFrame:
    """``company_id, status, name`` of boards' answers (``company_id, code, body``); the name is null unless the board gives one.

    A body that doesn't parse tells neither.
    """
    held = F.json_array_length(F.get_json_object("body", list_path))
    return answers.select("company_id", board_status(F.col("code"), held).alias("status"), F.when(F.col("code") == 200, F.nullif(F.trim(F.get_json_object("body", name_path)), F.lit(""))).alias("name"))


def board_status(code: Column, n_openings: Column) -> Column:
    """What a board's answer tells: NOT_FOUND, EMPTY, ACTIVE, or null where it can't be read."""
    return F.when(code == 404, "NOT_FOUND").when(code != 200, None).when(n_openings > 0, "ACTIVE").when(n_openings == 0, "EMPTY")
