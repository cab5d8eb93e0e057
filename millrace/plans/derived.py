"""Queries of what is derived from openings: titles, modes, years, names, profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import titles as T
from millrace.functions.numbers import match_score, wilson
from millrace.functions.text import clean_title
from millrace.operators.names import first_mentions, name_candidates, word_evidence, words_nearby
from millrace.operators.sampling import label_differences
from millrace.operators.title_tags import normalised_titles, roles_of
from millrace.plans.scored import VOCABULARY
from millrace.sources.tables import table


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "vacancy", "id", *columns).dropDuplicates(["id"])


def title_breakdown(spark: SparkSession, d: str) -> DataFrame:
    title = F.col("title")
    return _once(spark, d, "title").select("id", T.normal_title(title).alias("normal"), T.management_level(title).alias("management"))


def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Openings by the roles of their titles, those without one included; an opening of two roles counts for both."""
    heads = {"engineer": "engineering", "developer": "engineering", "architect": "architecture", "designer": "design", "analyst": "analysis", "manager": "management", "specialist": "operations", "technician": "operations"}
    titles = normalised_titles(_once(spark, d, "title"), "title", VOCABULARY)
    roles = roles_of(F.col("titles"), {"data analyst": "data"}, heads)
    return titles.select(F.explode_outer(roles).alias("role")).groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def years_of_experience(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "description").select("id", T.years_asked(F.col("description")).alias("years"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Openings by the level their title or else the years asked for give."""
    named = F.when(F.col("title").rlike(r"(?i)\b(?:senior|sr)\b"), "SENIOR").when(F.col("title").rlike(r"(?i)\b(?:junior|jr)\b"), "JUNIOR")
    return _once(spark, d, "title", "description").groupBy(T.level_of(named, T.years_asked(F.col("description"))).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def mode_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What decides the mode of work: location, field, title, description, or nothing; by source."""
    rows = _once(spark, d, "ats", "title", "location", "description", "workplace_type")
    modes, evidence = T.first_evidence(**{c: T.named_modes(F.col(k)) for c, k in (("location", "location"), ("field", "workplace_type"), ("title", "title"), ("description", "description"))})
    return rows.select("ats", evidence.alias("evidence"), F.array_join(modes, ",").alias("modes")).groupBy("ats", "evidence", "modes").agg(F.count(F.lit(1)).alias("n"))


def title_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of openings whose cleaned title is among the 100, 300 and 1000 commonest."""
    counts = _once(spark, d, "title").groupBy(clean_title(F.col("title")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.desc("n"), "t").limit(1000).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "t")))
    total = counts.agg(F.sum("n")).scalar()
    return ranked.agg(*(F.round(F.sum(F.when(F.col("rank") <= k, F.col("n"))) / total, 6).alias(f"top_{k}") for k in (100, 300, 1000)))


def title_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest raw titles of each department and level."""
    nv = table(spark, d, "normalized_vacancy", "vacancy_id", "seniority_level")
    rows = _once(spark, d, "department", "title").join(nv, F.col("id") == F.col("vacancy_id")).where("title is not null")
    counts = rows.groupBy("department", "seniority_level", "title").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("department", "seniority_level").orderBy(F.desc("n"), "title"))
    return counts.withColumn("rank", rank).where("rank <= 3")


def level_series(spark: SparkSession, d: str) -> DataFrame:
    """Share of each level within a source, with its interval; cells below ten are left blank."""
    nv = table(spark, d, "normalized_vacancy", "vacancy_id", "seniority_level").where("seniority_level is not null")
    ats = table(spark, d, "vacancy", "id", "ats").distinct()
    counts = nv.join(ats, F.col("vacancy_id") == F.col("id")).groupBy("ats", "seniority_level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("ats").agg(F.sum("n").alias("total"))
    low, high = wilson(F.col("n"), F.col("total"))
    shown = lambda x: F.when(F.col("n") >= 10, F.round(x, 6))
    return counts.join(totals, "ats").select("ats", "seniority_level", "n", shown(F.col("n") / F.col("total")).alias("share"), shown(low).alias("low"), shown(high).alias("high"))


def new_names(spark: SparkSession, d: str) -> DataFrame:
    """Words that three companies or more write as names, places aside."""
    evidence = word_evidence(_once(spark, d, "company_id", "description"), "id", "company_id", "description")
    places = table(spark, d, "place", "name").select(F.explode(F.split("name", r"[^\p{L}\p{N}]+")).alias("word"))
    return name_candidates(evidence, places)


def near_words(spark: SparkSession, d: str) -> DataFrame:
    return words_nearby(table(spark, d, "vacancy", "id", "title").dropDuplicates(["id"]), "id", "title", 2).where("n_docs >= 20")


def first_named(spark: SparkSession, d: str) -> DataFrame:
    return first_mentions(_once(spark, d, "description"), "id", "description", "fraud review").select("id", "line_no")


def mode_always_known(spark: SparkSession, d: str) -> DataFrame:
    """Companies of which every opening names its mode."""
    return table(spark, d, "vacancy", "company_id", "workplace_type").groupBy("company_id").agg(F.bool_and(F.col("workplace_type").isNotNull()).alias("known"), F.count(F.lit(1)).alias("n")).where("known").select("company_id", "n")


def value_latency(spark: SparkSession, d: str) -> DataFrame:
    """Median, 95th percentile by nearest rank and largest value, and errors, by hour of the day."""
    rows = table(spark, d, "events", "ts", "value", "event_type").where("value is not null")
    return rows.groupBy(F.hour("ts").alias("hour"), F.floor(F.dayofmonth("ts") / 8).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"), F.round(F.expr("percentile_disc(0.95) within group (order by value)"), 6).alias("p95"),
        F.round(F.max("value"), 6).alias("most"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


def top_departments(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 20 commonest pairs of department and commitment, then by name."""
    rows = table(spark, d, "vacancy", "department", "commitment").where("department is not null and commitment is not null")
    return rows.groupBy("department", "commitment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "department", "commitment").limit(20)


def level_differences(spark: SparkSession, d: str) -> DataFrame:
    """Openings whose recorded level is other than the one their years give."""
    nv = table(spark, d, "normalized_vacancy", "vacancy_id", "seniority_level", "required_years")
    expected = nv.select("vacancy_id", T.level_of(F.lit(None).cast("string"), F.col("required_years")).alias("level")).where("level is not null")
    return label_differences(expected, nv.select("vacancy_id", F.col("seniority_level").alias("level")).where("level is not null"))


def match_scores(spark: SparkSession, d: str) -> DataFrame:
    """How many of three modes an opening offers, as a score."""
    nv = table(spark, d, "normalized_vacancy", "vacancy_id", "work_modes", "seniority_level").where("work_modes is not null")
    score = match_score(F.size("work_modes"), F.lit(6), F.when(F.col("seniority_level") == "JUNIOR", 1), F.col("seniority_level").isNull())
    return nv.select("vacancy_id", F.round(score, 4).alias("score"))


QUERIES = {f.__name__: f for f in (
    title_breakdown, role_assignment, years_of_experience, levels, mode_evidence, title_coverage, title_profiles, level_series,
    new_names, near_words, first_named, mode_always_known, value_latency, top_departments, level_differences, match_scores,
)}

_V = "WITH v AS (SELECT id, any_value(ats) AS ats, any_value(title) AS title, any_value(location) AS location, any_value(department) AS department, any_value(description) AS description, any_value(workplace_type) AS workplace_type FROM vacancy GROUP BY id)"
_NUMBER = "(?:[0-9]{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)"
_YEARS = rf"""y AS (SELECT id, regexp_extract_all(lower(description), '(?:^|[^\w$€£.,])({_NUMBER})(?:\s*(?:-|–|to|or)\s*{_NUMBER})?\s*\+?\s*(?:or more\s+)?(?:years?|yrs?)\b', 1) AS f FROM v),
  z AS (SELECT id, list_max(list_filter(list_transform(f, lambda x: coalesce(try_cast(x AS INT), list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], x))), lambda x: x <= 25)) AS years FROM y)"""


def _modes(column: str) -> str:
    edge = lambda words: rf"regexp_matches(coalesce({column}, ''), '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{words})(?:$|[^\p{{L}}\p{{N}}])')"
    return "list_filter([" + ", ".join(f"CASE WHEN {edge(w)} THEN '{m}' END" for m, w in T.MODES.items()) + "], lambda x: x IS NOT NULL)"


ORACLES = {
    "top_departments": "SELECT department, commitment, count(*) AS n FROM vacancy WHERE department IS NOT NULL AND commitment IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20",
    "level_differences": """WITH e AS (SELECT vacancy_id, CASE WHEN required_years <= 1 THEN 'ENTRY' WHEN required_years = 2 THEN 'JUNIOR' WHEN required_years <= 4 THEN 'MID' WHEN required_years <= 7 THEN 'SENIOR' WHEN required_years >= 8 THEN 'STAFF' END AS level FROM normalized_vacancy),
        x AS (SELECT * FROM e WHERE level IS NOT NULL), g AS (SELECT vacancy_id, seniority_level AS level FROM normalized_vacancy WHERE seniority_level IS NOT NULL)
        SELECT *, 'missing' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM g) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM x)""",
    "match_scores": """SELECT vacancy_id, round(greatest(0, 100.0 * len(work_modes) / 6 - CASE WHEN seniority_level = 'JUNIOR' THEN 15 ELSE 0 END - CASE WHEN seniority_level IS NULL THEN 10 ELSE 0 END)::DOUBLE, 4) AS score
        FROM normalized_vacancy WHERE work_modes IS NOT NULL""",
    "years_of_experience": _V + ", " + _YEARS + " SELECT id, years FROM z",
    "levels": _V + ", " + _YEARS + r""" SELECT coalesce(CASE WHEN regexp_matches(title, '(?i)\b(?:senior|sr)\b') THEN 'SENIOR' WHEN regexp_matches(title, '(?i)\b(?:junior|jr)\b') THEN 'JUNIOR' END,
        CASE WHEN years <= 1 THEN 'ENTRY' WHEN years = 2 THEN 'JUNIOR' WHEN years <= 4 THEN 'MID' WHEN years <= 7 THEN 'SENIOR' WHEN years >= 8 THEN 'STAFF' END) AS level, count(*) AS n FROM v JOIN z USING (id) GROUP BY 1""",
    "mode_evidence": _V + f""", m AS (SELECT ats, {_modes('location')} AS l, {_modes('workplace_type')} AS f, {_modes('title')} AS t, {_modes('description')} AS d FROM v)
        SELECT ats, CASE WHEN len(l) > 0 THEN 'LOCATION' WHEN len(f) > 0 THEN 'FIELD' WHEN len(t) > 0 THEN 'TITLE' WHEN len(d) > 0 THEN 'DESCRIPTION' ELSE 'NONE' END AS evidence,
          coalesce(array_to_string(CASE WHEN len(l) > 0 THEN l WHEN len(f) > 0 THEN f WHEN len(t) > 0 THEN t ELSE d END, ','), '') AS modes, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "title_profiles": _V + """ SELECT department, seniority_level, title, n, rank FROM (SELECT department, seniority_level, title, count(*) AS n,
          row_number() OVER (PARTITION BY department, seniority_level ORDER BY count(*) DESC, title) AS rank
        FROM v JOIN normalized_vacancy nv ON nv.vacancy_id = v.id WHERE title IS NOT NULL GROUP BY 1, 2, 3) WHERE rank <= 3""",
    "level_series": """WITH c AS (SELECT v.ats, n.seniority_level, count(*) AS n FROM normalized_vacancy n JOIN (SELECT DISTINCT id, ats FROM vacancy) v ON v.id = n.vacancy_id WHERE seniority_level IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT *, sum(n) OVER (PARTITION BY ats)::DOUBLE AS total FROM c)
        SELECT ats, seniority_level, n, CASE WHEN n >= 10 THEN round(n / total, 6) END AS share,
          CASE WHEN n >= 10 THEN round((n / total + 3.8416 / (2 * total) - 1.96 * sqrt(n / total * (1 - n / total) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total), 6) END AS low,
          CASE WHEN n >= 10 THEN round((n / total + 3.8416 / (2 * total) + 1.96 * sqrt(n / total * (1 - n / total) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total), 6) END AS high FROM t""",
    "near_words": _V + r""", w AS (SELECT id, regexp_extract_all(lower(title), '\p{L}[\p{L}\p{N}+#.-]*') AS w FROM v), p AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        q AS (SELECT id, w[i] AS a, unnest(w[i + 1:i + 2]) AS b FROM p)
        SELECT least(a, b) AS word, greatest(a, b) AS near_word, count(DISTINCT id) AS n_docs FROM q WHERE a <> b GROUP BY 1, 2 HAVING count(DISTINCT id) >= 20""",
    "first_named": _V + r""", l AS (SELECT id, unnest(string_split(description, chr(10))) AS line, generate_subscripts(string_split(description, chr(10)), 1) AS n FROM v)
        SELECT id, min(n) AS line_no FROM l WHERE regexp_matches(line, '(?i)(?:^|[^\p{L}\p{N}])fraud[\s/_-]*review(?:$|[^\p{L}\p{N}])') GROUP BY id""",
    "mode_always_known": "SELECT company_id, count(*) AS n FROM vacancy GROUP BY 1 HAVING bool_and(workplace_type IS NOT NULL)",
    "value_latency": """SELECT hour(ts) AS hour, floor(day(ts) / 8)::BIGINT AS week, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95,
        round(max(value), 6) AS most, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
}
