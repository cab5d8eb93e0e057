"""Queries of scopes, rankings and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import profiles as profiled
from millrace.operators import scopes, scores
from millrace.operators.phrases import extract_from_segments
from millrace.operators.segments import segments
from millrace.operators.title_tags import AREA, HEAD, KIND, NOISE, RANK, Vocabulary, normalised_titles
from millrace.plans.texts import CLASSIFIER, NAME_FORM, TOPICS
from millrace.sources.tables import table

READABLE = ("en", "es")
UNDECIDED = ("DOMAIN_AMBIGUITY", "SCOPE_AMBIGUITY")


def scoped_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings by state of their title and by whether the next pass reads them, with the declared language or else the script's."""
    rows = table(spark, d, "vacancy", "id", "title", "language", "description").dropDuplicates(["id"])
    lang = F.coalesce(F.lower("language"), T.script_language(F.col("description")))
    states = CLASSIFIER.classify(rows.select("id", "title", lang.alias("lang")), "title")
    scope = scopes.in_scope(F.col("state"), F.col("reason"), F.col("lang"), UNDECIDED, READABLE)
    return states.groupBy("state", "reason", scope.alias("in_scope")).agg(F.count(F.lit(1)).alias("n"))


def declared_modes(spark: SparkSession, d: str) -> DataFrame:
    """What each kind of board declares in the column of its own."""
    rows = table(spark, d, "vacancy", "id", "ats", "workplace_type", "commitment").dropDuplicates(["id"])
    own = scopes.variant(F.col("ats"), {"ASHBY": "workplace_type", "LEVER": "workplace_type", "GREENHOUSE": "commitment"})
    return rows.groupBy("ats", own.alias("declared")).agg(F.count(F.lit(1)).alias("n"))


def openings_by_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_vacancy", "id", "vacancy_id", "work_modes").join(table(spark, d, "vacancy", F.col("id").alias("vacancy_id"), "first_published_at").dropDuplicates(["vacancy_id"]), "vacancy_id")
    return scopes.ranked_by_items(rows, "id", F.col("work_modes"), ["REMOTE", "HYBRID"], "first_published_at").select("id", "vacancy_id", "n_met")


def hidden_openings(spark: SparkSession, d: str) -> DataFrame:
    """How many senior remote openings of at most five years are shown, and how many a value that isn't declared hides."""
    rows = table(spark, d, "normalized_vacancy", "id", "vacancy_id", "seniority_level", "required_years", "work_modes").withColumn("published", F.lit(None).cast("timestamp"))
    wanted = {"level": F.col("seniority_level") == "SENIOR", "years": F.col("required_years") <= 5, "mode": F.array_contains("work_modes", "REMOTE")}
    return scopes.find(rows, wanted, "published", "id")[1]


def snapshot_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The third snapshot's (company, department, location, title) scored against the fourth's."""
    rows = table(spark, d, "vacancy_snapshot", "snapshot_no", "company_id", "department", "location", "title").where("company_id is not null and department is not null")
    found, expected = (rows.where(F.col("snapshot_no") == n).drop("snapshot_no") for n in (3, 4))
    scored = scores.hierarchical_scores(expected, found, "company_id", ["department", "location", "title"])
    return scored.select("n_found", "right", "coarser", "wrong", "n_expected", "recalled", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def remote_reach(spark: SparkSession, d: str) -> DataFrame:
    """The share of remote openings estimated from those that declare a mode, by board weighted with all its openings."""
    rows = table(spark, d, "vacancy", "id", "ats", "workplace_type").dropDuplicates(["id"]).where("ats is not null")
    sizes = rows.groupBy("ats").agg(F.count(F.lit(1)).alias("size"))
    labels = rows.withColumn("hit", F.col("workplace_type") == "Remote")
    return scores.stratified_share(labels, "ats", "hit", sizes).select(F.round("share", 6).alias("share"), F.round("error", 6).alias("error"), F.round("reach", 3).alias("reach"))


def mode_sets(spark: SparkSession, d: str) -> DataFrame:
    """The ten commonest sets of modes."""
    rows = table(spark, d, "normalized_vacancy", "id", F.explode_outer("work_modes").alias("mode"))
    return scores.commonest_sets(rows, "id", "mode", 10).select(F.array_join("items", ",").alias("modes"), "n_keys")


def mode_ceilings(spark: SparkSession, d: str) -> DataFrame:
    """Declared modes that the first derived mode doesn't equal, against what is allowed of each."""
    expected = table(spark, d, "vacancy", "id", "workplace_type").dropDuplicates(["id"]).select("id", F.upper("workplace_type").alias("mode")).where("mode is not null")
    found = table(spark, d, "normalized_vacancy", F.col("vacancy_id").alias("id"), F.get("work_modes", F.lit(0)).alias("mode"))
    return scores.within_ceilings(expected, found, "id", "mode", {"REMOTE": 100, "ONSITE": 300})


def location_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Typed locations by board: all, blank, those written as a place is listed, and the rest."""
    rows = table(spark, d, "vacancy", "id", "ats", "location").dropDuplicates(["id"])
    names = table(spark, d, "place", F.col("name").alias("location")).distinct().withColumn("_listed", F.lit(True))
    both = rows.join(names, "location", "left")
    blank, listed = F.coalesce(F.trim("location"), F.lit("")) == "", F.col("_listed").isNotNull()
    return both.groupBy("ats").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("n_blank"), F.count_if(listed).alias("n_listed"), F.count_if(~blank & ~listed).alias("n_rest"))


def location_residue(spark: SparkSession, d: str) -> DataFrame:
    """The twenty commonest typed locations that aren't written as a place is listed."""
    typed = table(spark, d, "normalized_vacancy_location", "location").where("trim(location) <> ''")
    rest = typed.join(table(spark, d, "place", F.col("name").alias("location")).distinct(), "location", "left_anti")
    return rest.groupBy("location").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "location").limit(20)


def topics_in_segments(spark: SparkSession, d: str) -> DataFrame:
    """Topics of each opening by title and segments, boilerplate left out."""
    rows = table(spark, d, "vacancy", "id", "title", "description").dropDuplicates(["id"]).withColumn("segments", segments(F.col("description")))
    found = extract_from_segments(rows, "id", "title", "segments", TOPICS)
    return found.select("id", "entry", F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments"), "from_context")


# Fixed values of the demonstration: words of titles, and how some are respelled.
VOCABULARY = Vocabulary(
    tags=dict.fromkeys("engineer developer architect analyst designer manager specialist technician".split(), HEAD)
    | dict.fromkeys("backend frontend cloud platform mobile data security network firmware payments billing quality search growth clinical logistics support field".split(), AREA)
    | dict.fromkeys(["field service", "data platform"], KIND) | dict.fromkeys("senior junior lead staff principal".split(), RANK) | dict.fromkeys(["remote", "hybrid", "all genders"], NOISE),
    respelled={"sr.": "senior", "jr.": "junior", "back end": "backend", "front end": "frontend", "analista": "analyst", "analyste": "analyst", "ingeniera": "engineer"},
)


def composed_titles(spark: SparkSession, d: str) -> DataFrame:
    """How often each composed title occurs; openings without one have null."""
    rows = table(spark, d, "vacancy", "id", "title").dropDuplicates(["id"])
    return normalised_titles(rows, "title", VOCABULARY).select("id", F.explode_outer("titles").alias("composed")).groupBy("composed").agg(F.count(F.lit(1)).alias("n"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower(F.trim("title")), r"[^\p{L}]+"))
    return table(spark, d, "vacancy", "id", "department", "title").select("id", "department", F.explode(words).alias("word")).where("word <> ''")


def department_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Share of each department, and of its openings on each level."""
    nv = table(spark, d, "normalized_vacancy", F.col("vacancy_id").alias("id"), "seniority_level")
    rows = table(spark, d, "vacancy", "id", "department").distinct().join(nv, "id", "left")
    profiles = profiled.group_shares(rows, "department", "id", "seniority_level")
    levels = F.transform(F.array_sort(F.map_entries("levels")), lambda e: F.concat_ws("=", e["key"], F.format_number(e["value"], 4)))
    return profiles.select("department", "n", F.round("share", 6).alias("share"), F.array_join(levels, ",").alias("levels"))


def department_items(spark: SparkSession, d: str) -> DataFrame:
    """The title words that set each department apart."""
    found = profiled.distinctive_items(_words(spark, d), "department", "id", "word", 0.02, 8)
    return found.select("department", "word", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"), "rank")


def department_nearest(spark: SparkSession, d: str) -> DataFrame:
    return profiled.nearest_groups(_words(spark, d), "department", "id", "word", 3).withColumn("nearness", F.round("nearness", 6))


def title_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Titles (their first parts) of four openings or more that end alike and whose descriptions use the same words."""
    rows = table(spark, d, "vacancy", "id", "title", "description").dropDuplicates(["id"])
    words = F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"\p{L}{4,}"), F.lit(0)))
    mentions = rows.select("id", F.get(T.title_parts(F.lower("title")), F.lit(0)).alias("title"), F.explode(words).alias("word"))
    return profiled.fragments(mentions, "title", "id", "word", 0.15, 4).withColumn("nearness", F.round("nearness", 6))


QUERIES = {f.__name__: f for f in (
    department_profiles, department_items, department_nearest, title_fragments, scoped_openings, declared_modes, openings_by_modes, hidden_openings, snapshot_agreement, remote_reach, mode_sets, mode_ceilings, location_tallies, location_residue, topics_in_segments, composed_titles,
)}

_ONCE = "SELECT id, any_value(ats) AS ats, any_value(title) AS title, any_value(location) AS location, any_value(workplace_type) AS workplace_type, any_value(commitment) AS commitment, any_value(language) AS language, any_value(description) AS description, any_value(first_published_at) AS published FROM vacancy GROUP BY id"


def _has(phrases: object) -> str:
    return " OR ".join(f"contains(t, ' {p} ')" for p in sorted(phrases))


def _scoped() -> str:
    heads = ", ".join(f"'{h}'" for h in sorted(CLASSIFIER.heads))
    domain = ", ".join(f"'{h}'" for h, needs in sorted(CLASSIFIER.heads.items()) if needs)
    letters = lambda s: f"length(regexp_replace(regexp_replace(description, '[^\\p{{L}}]', '', 'g'), '[^{s}]', '', 'g'))"
    scripts = {"ar": r"\p{Arabic}", "el": r"\p{Greek}", "he": r"\p{Hebrew}", "hi": r"\p{Devanagari}", "ko": r"\p{Hangul}", "ru": r"\p{Cyrillic}", "th": r"\p{Thai}", "ea": r"\p{Hiragana}\p{Katakana}\p{Han}"}
    share = " OR ".join(f"{letters(p)} >= 0.2 * n" for p in scripts.values())
    return f"""WITH v AS ({_ONCE}), f AS (SELECT id, language, description, length(regexp_replace(description, '[^\\p{{L}}]', '', 'g')) AS n, ' ' || array_to_string(string_split_regex({NAME_FORM.format('title')}, '\\s+'), ' ') || ' ' AS t FROM v),
        h AS (SELECT *, list_filter(string_split(trim(t), ' '), lambda w: w IN ({heads}))[-1] AS head, n >= 20 AND ({share}) AS other FROM f),
        s AS (SELECT *, CASE WHEN {_has(CLASSIFIER.rulings)} THEN 'IN' WHEN head IS NULL THEN 'UNKNOWN' WHEN {_has(CLASSIFIER.never | CLASSIFIER.disciplines)} THEN 'OUT' WHEN {_has(CLASSIFIER.qualifiers)} THEN 'IN' ELSE 'UNKNOWN' END AS state FROM h),
        r AS (SELECT *, CASE WHEN state <> 'UNKNOWN' THEN NULL WHEN head IS NULL THEN 'UNRULED' WHEN head IN ({domain}) THEN 'DOMAIN_AMBIGUITY' ELSE 'SCOPE_AMBIGUITY' END AS reason FROM s)
        SELECT state, reason, state = 'IN' OR coalesce(reason IN ('DOMAIN_AMBIGUITY', 'SCOPE_AMBIGUITY') AND (lower(language) IN ('en', 'es') OR language IS NULL AND coalesce(NOT other, true)), false) AS in_scope, count(*) AS n FROM r GROUP BY ALL"""


_WORDS = r"""WITH m AS (SELECT DISTINCT department AS g, id AS m, unnest(string_split_regex(lower(trim(title)), '[^\p{L}]+')) AS i FROM vacancy WHERE department IS NOT NULL), p AS (SELECT * FROM m WHERE i <> '')"""
_NEAR = """, n AS (SELECT g, count(DISTINCT m) AS n FROM p GROUP BY g), d AS (SELECT i, count(DISTINCT m) AS df FROM p GROUP BY i),
        w AS (SELECT p.g, p.i, count(*) / any_value(n.n)::DOUBLE * ln((SELECT count(DISTINCT m) FROM p) / any_value(d.df)::DOUBLE) AS w FROM p JOIN n USING (g) JOIN d USING (i) GROUP BY p.g, p.i),
        u AS (SELECT g, i, w / sqrt(sum(w * w) OVER (PARTITION BY g)) AS u FROM w WHERE w > 0), x AS (SELECT DISTINCT g FROM u),
        c AS (SELECT a.g AS a, b.g AS b, coalesce(sum(s.u * t.u), 0) AS c FROM x a JOIN x b ON a.g <> b.g LEFT JOIN u s ON s.g = a.g LEFT JOIN u t ON t.g = b.g AND t.i = s.i GROUP BY a.g, b.g)"""

ORACLES = {
    "department_profiles": """WITH e AS (SELECT v.department AS g, v.id AS m, min(n.seniority_level) AS l FROM (SELECT DISTINCT id, department FROM vacancy) v LEFT JOIN normalized_vacancy n ON n.vacancy_id = v.id WHERE v.department IS NOT NULL GROUP BY ALL),
        c AS (SELECT g, coalesce(l, 'none') AS l, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT g, sum(n) AS n FROM c GROUP BY g)
        SELECT g AS department, t.n::BIGINT AS n, round(t.n / (SELECT sum(n) FROM t)::DOUBLE, 6) AS share, string_agg(l || '=' || printf('%.4f', c.n / t.n::DOUBLE), ',' ORDER BY l) AS levels FROM c JOIN t USING (g) GROUP BY g, t.n""",
    "department_items": _WORDS + """, n AS (SELECT g, count(DISTINCT m) AS n FROM p GROUP BY g), o AS (SELECT i, count(DISTINCT m) / (SELECT count(DISTINCT m) FROM p)::DOUBLE AS s FROM p GROUP BY i),
        k AS (SELECT p.g, p.i, count(*) / any_value(n.n)::DOUBLE AS share FROM p JOIN n USING (g) GROUP BY p.g, p.i), l AS (SELECT g, i, share, share / s AS lift FROM k JOIN o USING (i) WHERE share >= 0.02)
        SELECT g AS department, i AS word, round(share, 6) AS share, round(lift, 6) AS lift, row_number() OVER (PARTITION BY g ORDER BY round(lift, 9) DESC, i)::INT AS rank FROM l QUALIFY rank <= 8""",
    "department_nearest": _WORDS + _NEAR + " SELECT a AS department, b AS near_department, round(c, 6) AS nearness, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b)::INT AS rank FROM c QUALIFY rank <= 3",
    "title_fragments": r"""WITH v AS (SELECT id, list_filter(list_transform(string_split_regex(lower(any_value(title)), '[,;|()\[\]{}:]|\s[-–—]\s'), lambda x: trim(x)), lambda x: x <> '')[1] AS title, any_value(description) AS description FROM vacancy GROUP BY id), q AS (SELECT title FROM v WHERE description IS NOT NULL AND length(regexp_extract(lower(description), '\p{L}{4,}')) > 0 GROUP BY title HAVING count(*) >= 4),
        p AS (SELECT DISTINCT title AS g, id AS m, unnest(regexp_extract_all(lower(description), '\p{L}{4,}')) AS i FROM v JOIN q USING (title))""" + _NEAR + r"""
        SELECT a AS title, b AS near_title, round(c, 6) AS nearness FROM c WHERE a < b AND c >= 0.15 AND regexp_extract(a, '\S+$') = regexp_extract(b, '\S+$')""",
    "scoped_openings": _scoped(),
    "declared_modes": f"SELECT ats, CASE WHEN ats IN ('ASHBY', 'LEVER') THEN workplace_type WHEN ats = 'GREENHOUSE' THEN commitment END AS declared, count(*) AS n FROM ({_ONCE}) GROUP BY ALL",
    "openings_by_modes": f"""SELECT n.id, n.vacancy_id, CASE WHEN work_modes IS NULL THEN 0 ELSE len(list_distinct(list_filter(work_modes, lambda m: m IN ('REMOTE', 'HYBRID')))) END::INT AS n_met
        FROM normalized_vacancy n JOIN ({_ONCE}) v ON v.id = n.vacancy_id""",
    "hidden_openings": """WITH j AS (SELECT seniority_level = 'SENIOR' AS l, required_years <= 5 AS y, list_contains(work_modes, 'REMOTE') AS m FROM normalized_vacancy)
        SELECT count(*) FILTER (l AND y AND m) AS n_shown, count(*) FILTER (l IS NULL AND y AND m) AS hidden_level, count(*) FILTER (l AND y IS NULL AND m) AS hidden_years, count(*) FILTER (l AND y AND m IS NULL) AS hidden_mode FROM j""",
    "snapshot_agreement": """WITH f AS (SELECT DISTINCT company_id, department, location, title FROM vacancy_snapshot WHERE snapshot_no = 3 AND company_id IS NOT NULL AND department IS NOT NULL),
        e AS (SELECT DISTINCT company_id, department, location, title FROM vacancy_snapshot WHERE snapshot_no = 4 AND company_id IS NOT NULL AND department IS NOT NULL),
        m AS (SELECT f.*, CASE WHEN e.department IS NULL OR e.department <> f.department THEN 0 WHEN e.location IS NOT DISTINCT FROM f.location AND e.title IS NOT DISTINCT FROM f.title THEN 2
            WHEN f.location IS NULL AND e.location IS NOT NULL THEN 1 WHEN e.location IS NOT DISTINCT FROM f.location AND f.title IS NULL AND e.title IS NOT NULL THEN 1 ELSE 0 END AS a FROM f LEFT JOIN e ON e.company_id = f.company_id),
        b AS (SELECT company_id, department, location, title, max(a) AS a FROM m GROUP BY ALL),
        r AS (SELECT count(*) AS n FROM (SELECT * FROM e INTERSECT SELECT * FROM f))
        SELECT count(*) AS n_found, count(*) FILTER (a = 2) AS "right", count(*) FILTER (a = 1) AS coarser, count(*) FILTER (a = 0) AS wrong, (SELECT count(*) FROM e) AS n_expected, (SELECT n FROM r) AS recalled,
          round(count(*) FILTER (a > 0) / count(*)::DOUBLE, 6) AS precision, round((SELECT n FROM r) / (SELECT count(*) FROM e)::DOUBLE, 6) AS recall FROM b""",
    "remote_reach": f"""WITH v AS ({_ONCE}), s AS (SELECT ats, count(*)::DOUBLE AS s, avg((workplace_type = 'Remote')::INT) AS p, count(workplace_type) AS n FROM v WHERE ats IS NOT NULL GROUP BY ats)
        SELECT round(sum(p * s) / sum(s), 6) AS share, round(sqrt(sum(CASE WHEN n > 1 THEN s * s * p * (1 - p) / (n - 1) ELSE 0 END)) / sum(s), 6) AS error, round(sum(p * s), 3) AS reach FROM s WHERE n > 0""",
    "mode_sets": """SELECT array_to_string(list_sort(list_distinct(coalesce(work_modes, []))), ',') AS modes, count(*) AS n_keys FROM normalized_vacancy GROUP BY 1
        ORDER BY n_keys DESC, array_to_string(list_sort(list_distinct(any_value(coalesce(work_modes, [])))), chr(10)) LIMIT 10""",
    "mode_ceilings": f"""WITH e AS (SELECT id, upper(workplace_type) AS mode FROM ({_ONCE}) WHERE workplace_type IS NOT NULL)
        SELECT e.mode, count(*) AS n_expected, count(*) FILTER (n.work_modes[1] IS DISTINCT FROM e.mode) AS n_wrong,
          count(*) FILTER (n.work_modes[1] IS DISTINCT FROM e.mode) <= CASE e.mode WHEN 'REMOTE' THEN 100 WHEN 'ONSITE' THEN 300 ELSE 0 END AS within
        FROM e LEFT JOIN normalized_vacancy n ON n.vacancy_id = e.id GROUP BY e.mode""",
    "location_tallies": f"""SELECT ats, count(*) AS n, count(*) FILTER (coalesce(trim(location), '') = '') AS n_blank, count(*) FILTER (location IN (SELECT name FROM place)) AS n_listed,
          count(*) FILTER (coalesce(trim(location), '') <> '' AND location NOT IN (SELECT name FROM place)) AS n_rest FROM ({_ONCE}) GROUP BY ats""",
    "location_residue": """SELECT location, count(*) AS n FROM normalized_vacancy_location WHERE trim(location) <> '' AND location NOT IN (SELECT name FROM place) GROUP BY location ORDER BY n DESC, location LIMIT 20""",
}
