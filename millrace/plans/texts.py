"""Queries of the text, title and address rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.numbers import wilson
from millrace.functions.urls import board_region, board_slug, surt_prefix
from millrace.operators import segments as seg
from millrace.operators.phrases import Classifier, Entry, extract_entries, phrase_labels
from millrace.sources.tables import table

HOSTS = r"boards\.[a-z]+\.example"


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "vacancy", "id", *columns).dropDuplicates(["id"])


def title_cleaning(spark: SparkSession, d: str) -> DataFrame:
    levels, _ = T.seniority_words(T.title_characters(T.without_gender_marker(F.coalesce("title", F.lit("")))))
    return _once(spark, d, "title").select("id", T.spaced(F.col("title")).alias("even"), F.array_join(levels, ",").alias("levels"), T.clean_title(F.col("title")).alias("cleaned"))


def title_collapse(spark: SparkSession, d: str) -> DataFrame:
    """How many titles are left after each rule alone, and after all."""
    t = F.coalesce(F.col("title"), F.lit(""))
    rules: dict[str, Column] = {
        "distinct_titles": t, "by_spacing": T.spaced(t), "by_gender_marker": T.without_gender_marker(t),
        "by_characters": T.title_characters(t), "by_seniority": T.seniority_words(t)[1], "distinct_cleaned": T.clean_title(t),
    }
    return table(spark, d, "vacancy", "title").agg(*(F.count_distinct(v).alias(k) for k, v in rules.items()))


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the names of companies and, numbered below 0, of the titles of openings."""
    titles = table(spark, d, "vacancy", "id", "title").distinct().select((-1 - F.col("id")).alias("id"), F.col("title").alias("name"))
    names = table(spark, d, "company", "id", "name").unionByName(titles)
    return names.select("id", T.name_form(F.col("name")).alias("form"), T.folded(F.col("name")).alias("folded"))


def description_cleaning(spark: SparkSession, d: str) -> DataFrame:
    cleaned = T.clean_description(F.col("description"))
    return _once(spark, d, "description").select("id", F.length(cleaned).alias("n_chars"), F.md5(cleaned.cast("binary")).alias("digest"))


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs, and in how many openings, over all descriptions."""
    words = _once(spark, d, "description").select("id", F.explode(T.tokens(F.col("description"))).alias("word"))
    per = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n_uses"), F.count(F.lit(1)).alias("n_openings")).where("n_openings >= 10")


def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.detected_language(F.lit(None), F.col("text")).alias("detected"))


def language_shares(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the texts that are left once equal folded texts are taken once, with intervals."""
    # the language is told before the shuffle, so that no text is shuffled
    digest = T.bound(T.folded(F.col("text")), lambda x: F.when(x != "", F.struct(F.xxhash64(x), F.length(x))))
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", digest.alias("digest"), T.detected_language(F.lit(None), F.col("text")).alias("lang"))
    kept = rows.where("digest is not null").groupBy("digest").agg(F.min_by("lang", "doc_id").alias("lang"))
    counts = kept.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    low, high = wilson(F.col("n"), total)
    return counts.select("lang", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def bags_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Titles of which others have the same words in another order."""
    titles = table(spark, d, "vacancy", "title").where("title is not null").distinct()
    bags = titles.groupBy(T.bag_of_words(F.col("title")).alias("bag")).agg(F.count(F.lit(1)).alias("n_titles"), F.min("title").alias("first_title"))
    return bags.where("n_titles > 1")


def title_part_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = _once(spark, d, "title").select(F.explode(T.title_parts(F.col("title"))).alias("part"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _once(spark, d, "description").select(F.explode(F.split("description", "\n")).alias("line"))
    body = F.regexp_replace(F.trim("line"), "^(> )?# ", "")
    return lines.select(body.alias("line")).where((F.col("line") != "") & T.is_heading(F.col("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def one_line_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.size(T.simple_sentences(F.col("line"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_sentences"))


# Fixed values of the demonstration: headings, and words that items begin with.
HEADINGS, ITEM_STARTS = frozenset({"what we offer", "who you are", "how to apply"}), ("You", "We", "Our", "Experience", "Ability", "Knowledge")


def description_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of descriptions with the heading above and the kind of the next one."""
    rows = _once(spark, d, "description").withColumn("all", seg.segments(F.col("description"), HEADINGS, ITEM_STARTS))
    each = rows.select("id", "all", F.posexplode("all").alias("pos", "s"))
    return each.select("id", "pos", "s.kind", "s.under", "s.boilerplate", F.md5(seg.marked(F.col("s")).cast("binary")).alias("digest"), seg.neighbour(F.col("all"), F.col("pos"), 1)["kind"].alias("next_kind"))


# Fixed values of the demonstration: words of titles as heads, and what decides a title.
CLASSIFIER = Classifier(
    rulings={"data analyst": "IN"}, never=frozenset({"clinical", "billing"}), disciplines=frozenset({"field", "logistics"}),
    qualifiers=frozenset({"backend", "frontend", "cloud", "platform", "mobile", "data", "security", "network"}),
    heads={"engineer": False, "developer": False, "architect": False, "analyst": True, "designer": True, "manager": True, "specialist": True, "technician": True},
)


FIELDS = {w: w.upper() for w in "backend frontend mobile data cloud security network platform support billing field quality search growth".split()}
FIELDS |= {"data platform": "DATA PLATFORM", "cloud security": "CLOUD SECURITY", "mobile growth": "MOBILE GROWTH"}


def title_states(spark: SparkSession, d: str) -> DataFrame:
    """Tally of states and reasons by the dictionary classifier."""
    titles = _once(spark, d, "title").select("id", T.clean_title(F.col("title")).alias("title"))
    return CLASSIFIER.classify(titles, "title").groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n"))


def title_fields(spark: SparkSession, d: str) -> DataFrame:
    """The label of the longest listed phrase of each title."""
    return phrase_labels(_once(spark, d, "title"), "title", FIELDS).select("id", "label")


TOPICS = [
    Entry("payments", ("payment routing", "tenant billing", "invoice matching")), Entry("fraud", ("fraud review",), (), "payments"), Entry("logistics", ("parcel sorting", "fleet tracking", "warehouse planning")),
    Entry("energy", ("energy trading", "grid balancing")), Entry("health", ("patient records", "claims handling")), Entry("crew", ("crew rostering", "course scheduling"), ("Expect",)),
]


def topics_found(spark: SparkSession, d: str) -> DataFrame:
    found = extract_entries(_once(spark, d, "description"), "id", "description", TOPICS)
    return found.select("id", "entry", F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments"), "from_context")


def topic_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Openings by number of topics, those without any included."""
    rows = _once(spark, d, "description")
    found = extract_entries(rows, "id", "description", TOPICS).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("id").join(found, "id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_topics")).agg(F.count(F.lit(1)).alias("n_openings"))


def addresses(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _once(spark, d, "url").select("id", surt_prefix(url).alias("surt"), board_slug(url, HOSTS).alias("slug"), board_region(url).alias("region"))


def discovered_boards(spark: SparkSession, d: str) -> DataFrame:
    """Boards that addresses name and companies don't hold, with EU winning where both regions are seen."""
    url = F.col("url")
    seen = table(spark, d, "vacancy", "ats", "url").select("ats", board_slug(url, HOSTS).alias("slug"), board_region(url).alias("region")).where("slug is not null")
    found = seen.groupBy("ats", "slug").agg(F.when(F.max((F.col("region") == "EU").cast("int")) == 1, "EU").otherwise("US").alias("region"), F.count(F.lit(1)).alias("n_seen"))
    return found.join(table(spark, d, "company", "ats", "slug").where("board_status = 'ACTIVE'"), ["ats", "slug"], "left_anti")


QUERIES = {f.__name__: f for f in (
    title_cleaning, title_collapse, name_forms, description_cleaning, word_tokens, detected_languages, language_shares, bags_of_words, title_part_counts,
    heading_lines, one_line_sentences, description_segments, title_states, title_fields, topics_found, topic_histogram, addresses, discovered_boards,
)}

#: SQL of a name's form: what T.name_form gives.
NAME_FORM = r"""CASE WHEN regexp_full_match(lower(trim({0})), '[\s_/-]*') THEN lower(trim({0})) ELSE regexp_extract(lower(trim({0})), '^[\s_/-]*')
  || regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^[\s_/-]+', ''), '[\s_/-]+$', ''), '[\s_/-]+', ' ', 'g') || regexp_extract(lower(trim({0})), '[\s_/-]*$') END"""

_V = "WITH v AS (SELECT id, any_value(title) AS title, any_value(description) AS description, any_value(url) AS url FROM vacancy GROUP BY id)"


def _sql_language(column: str) -> str:
    letters = lambda s: f"length(regexp_replace(regexp_replace({column}, '[^\\p{{L}}]', '', 'g'), '[^{s}]', '', 'g'))"
    scripts = {"ar": r"\p{Arabic}", "el": r"\p{Greek}", "he": r"\p{Hebrew}", "hi": r"\p{Devanagari}", "ko": r"\p{Hangul}", "ru": r"\p{Cyrillic}", "th": r"\p{Thai}"}
    n = letters(r"\p{L}")
    kana, han = letters(r"\p{Hiragana}\p{Katakana}"), letters(r"\p{Han}")
    most = "list_sort([" + ", ".join(f"{{'n': {letters(p)}, 'c': '{c}'}}" for c, p in scripts.items()) + "], 'DESC')[1]"
    words = f"string_split_regex(lower({column}), '[^\\p{{L}}]+')"
    counts = ", ".join(f"{{'n': len(list_filter({words}, lambda w: list_contains({listed}, w))), 'c': '{c}'}}" for c, listed in T.FUNCTION_WORDS.items())
    ranked = f"list_sort([{counts}], 'DESC')"
    return f"""CASE WHEN {n} < 20 THEN NULL WHEN {kana} > 0 AND ({kana} >= {n} * 0.2 OR {kana} + {han} >= {n} * 0.2) THEN 'ja'
      WHEN {han} > 0 AND {han} >= {n} * 0.2 THEN 'zh'
      WHEN {most}.n > 0 AND {most}.n >= {n} * 0.2 THEN CASE WHEN {most}.c = 'ru' AND regexp_matches(lower({column}), '[{T.UKRAINIAN_LETTERS}]') THEN 'uk' ELSE {most}.c END
      WHEN {ranked}[1].n >= 3 AND {ranked}[1].n > {ranked}[2].n THEN {ranked}[1].c END"""


ORACLES = {
    "name_forms": rf"""WITH n AS (SELECT id, name FROM company UNION ALL SELECT -1 - id, title FROM (SELECT DISTINCT id, title FROM vacancy))
        SELECT id, {NAME_FORM.format('name')} AS form, lower(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))) AS folded FROM n""",
    "title_fields": _V + rf""", t AS (SELECT id, string_split_regex({NAME_FORM.format('title')}, '\s+') AS w FROM v WHERE trim(title) <> ''),
        g AS (SELECT id, i AS pos, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM t, range(1, 3) r(k), range(1, 200) s(i) WHERE i + k - 1 <= len(w)),
        d AS (SELECT unnest([{', '.join(f"'{p}'" for p in FIELDS)}]) AS phrase),
        b AS (SELECT id, phrase FROM g JOIN d USING (phrase) QUALIFY row_number() OVER (PARTITION BY id ORDER BY size DESC, pos) = 1)
        SELECT v.id, upper(b.phrase) AS label FROM v LEFT JOIN b USING (id)""",
    "description_cleaning": _V + r""", c AS (SELECT id, description, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(description, '[^\p{L}\p{N}\p{M}\p{P}\p{Sc}\p{Sm}\p{Sk}\n\r]', ' ', 'g'), '[\x{FE00}-\x{FE0F}]|[\x{E0100}-\x{E01EF}]', ' ', 'g'), '\r\n|[\n\r]'),
          lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS lines FROM v)
        SELECT id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT id, CASE WHEN description IS NULL THEN NULL ELSE coalesce(array_to_string(lines, chr(10)), '') END AS t FROM c)""",
    "heading_lines": _V + r""", l AS (SELECT regexp_replace(trim(unnest(string_split(description, chr(10)))), '^(> )?# ', '') AS line FROM v),
        w AS (SELECT line, string_split_regex(lower(regexp_replace(line, ':$', '')), '\s+') AS words FROM l WHERE line <> '')
        SELECT line, count(*) AS n FROM w WHERE length(line) <= 60 AND NOT regexp_matches(line, '[.!?]\s*$')
          AND (regexp_matches(line, ':\s*$') OR line = upper(line) AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 4
            OR len(words) <= 4 AND (words[1] IN ('requirements', 'benefits', 'responsibilities', 'team', 'role') OR words[-1] IN ('requirements', 'benefits', 'responsibilities', 'team', 'role')))
        GROUP BY line""",
    "word_tokens": _V + r""", w AS (SELECT id, unnest(regexp_extract_all(description, '[\p{L}\p{N}]+(?:[.&''-][\p{L}\p{N}]+)*[+#]*')) AS word FROM v)
        SELECT lower(word) AS word, count(*) AS n_uses, count(DISTINCT id) AS n_openings FROM w GROUP BY lower(word) HAVING count(DISTINCT id) >= 10""",
    "detected_languages": f"SELECT doc_id, {_sql_language('text')} AS detected FROM documents",
    "language_shares": rf"""WITH f AS (SELECT doc_id, text, lower(trim(regexp_replace(text, '[\s\x{{00a0}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{202f}}]+', ' ', 'g'))) AS k FROM documents WHERE text IS NOT NULL),
        o AS (SELECT k, arg_min(text, doc_id) AS text FROM f WHERE k <> '' GROUP BY k),
        c AS (SELECT coalesce({_sql_language('text')}, 'none') AS lang, count(*) AS n FROM o GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM c)
        SELECT lang, n, round(n / total, 6) AS share,
          round((n / total + 3.8416 / (2 * total) - 1.96 * sqrt(n / total * (1 - n / total) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total), 6) AS low,
          round((n / total + 3.8416 / (2 * total) + 1.96 * sqrt(n / total * (1 - n / total) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total), 6) AS high FROM c, t""",
    "bags_of_words": r"""WITH t AS (SELECT DISTINCT title FROM vacancy WHERE title IS NOT NULL),
        b AS (SELECT title, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(title), '\s+'), lambda x: x <> ''))), ' ') AS bag FROM t)
        SELECT bag, count(*) AS n_titles, min(title) AS first_title FROM b GROUP BY bag HAVING count(*) > 1""",
    "title_part_counts": _V + r""", p AS (SELECT trim(unnest(string_split_regex(title, '[,;|()\[\]{}:]|\s[-–—]\s'))) AS part FROM v)
        SELECT part, count(*) AS n FROM p WHERE part <> '' GROUP BY part""",
    "addresses": _V + r""", u AS (SELECT id, url, lower(regexp_extract(url, '^https://([^/?#]+)', 1)) AS host FROM v)
        SELECT id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(lower(url), '^[a-z]+://[^/?#]*(/[^#]*)?', 1) AS surt,
          nullif(regexp_extract(lower(url), '^https://boards\.[a-z]+\.example/([a-z0-9][a-z0-9._-]*)(?:[/?#]|$)', 1), '') AS slug,
          CASE WHEN host = '' THEN NULL WHEN regexp_matches(host, '(^|\.)eu(\.|$)') THEN 'EU' ELSE 'US' END AS region FROM u""",
    "discovered_boards": r"""WITH s AS (SELECT ats, nullif(regexp_extract(lower(url), '^https://boards\.[a-z]+\.example/([a-z0-9][a-z0-9._-]*)(?:[/?#]|$)', 1), '') AS slug,
          regexp_matches(lower(url), '^https://([^/?#]*\.)?eu[./?#]') AS eu FROM vacancy)
        SELECT ats, slug, CASE WHEN bool_or(eu) THEN 'EU' ELSE 'US' END AS region, count(*) AS n_seen FROM s
        WHERE slug IS NOT NULL AND (ats, slug) NOT IN (SELECT (ats, slug) FROM company WHERE board_status = 'ACTIVE') GROUP BY ats, slug""",
}
