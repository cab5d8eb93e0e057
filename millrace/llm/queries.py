"""Queries of the llm problems over the recruiting tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.canonical import map_to_list
from millrace.llm.common_lines import repeated_lines, without_lines
from millrace.llm.languages import language_segments, named_language, train_words
from millrace.llm.mixing import mixture, mixture_plan, mixture_shares
from millrace.llm.near_duplicates import expanded_pairs, linked_groups, near_pairs
from millrace.llm.packing import pack, sequences
from millrace.llm.sentences import sentence_units, train_on
from millrace.llm.tokens import sized_texts
from millrace.session import cut_lineage
from millrace.sources.tables import table


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vacancy", "id", "language", "description")
    model = train_words(rows, "description", "language")
    once = language_segments(rows, "id", "language", "description", model).dropDuplicates(["id", "first_line"])
    return once.withColumnRenamed("id", "vacancy_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("vacancy_id")
    named = named_language(F.col("language"))
    case = (F.min("lang_code").over(own) != F.max("lang_code").over(own)) | named.isNull() | (named != F.col("lang_code"))
    return p4_segments(spark, d).withColumn("_case", case).where("_case").select("vacancy_id", "first_line", "lang_code")


def place_entries(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "place", "id", "name", "country", "population")
    named = places.select("name", F.col("id").alias("entry_id"), "country", "population")
    also = table(spark, d, "place_alias", "alias_name", "place_id").join(places.drop("name"), F.col("place_id") == F.col("id"))
    return named.unionByName(also.select(F.col("alias_name").alias("name"), F.col("id").alias("entry_id"), "country", "population"))


def country_words(spark: SparkSession, d: str) -> DataFrame:
    """``word, country``: the codes, names and subdivisions of each country."""
    places = table(spark, d, "place", "country", "country_name", "subdivision").distinct()
    return places.select("country", F.explode(F.array("country", "country_name", "subdivision")).alias("word"))


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "normalized_vacancy_location", "location")
    return map_to_list(typed, "location", place_entries(spark, d), country_words(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_vacancy_location", "normalized_vacancy_id", "list_name", "pos", "location")
    exact = table(spark, d, "place", F.col("name").alias("location")).distinct()
    free = rows.join(exact, "location", "left_anti")
    mapped = map_to_list(free, "location", place_entries(spark, d), country_words(spark, d)).withColumnRenamed("location", "_typed")
    joined = free.join(mapped, F.col("location").eqNullSafe(F.col("_typed")), "left")
    return joined.select("normalized_vacancy_id", "list_name", "pos", F.col("entry_id").alias("place_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vacancy", "id", "company_id", "description")
    slugs = table(spark, d, "company", F.col("id").alias("company_id"), "slug")
    return repeated_lines(rows, "id", "company_id", "description", slugs, "slug").withColumnRenamed("id", "vacancy_id")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vacancy", "id", "description")
    removed = p6_found(spark, d).withColumnRenamed("vacancy_id", "id")
    return without_lines(rows, "id", "description", removed).select(F.col("id").alias("vacancy_id"), "description")


LEAST_SIMILARITY, LEAST_LENGTH = 0.65, 200


def near_vacancies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "vacancy", "id", "title", "location", "description").where(F.length("description") >= LEAST_LENGTH)
    return near_pairs(rows, "id", ["title", "location", "description"], LEAST_SIMILARITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return expanded_pairs(*near_vacancies(spark, d)).select(F.col("a").alias("vacancy_id_a"), F.col("b").alias("vacancy_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(*near_vacancies(spark, d)).withColumnRenamed("key", "vacancy_id")


def setting(spark: SparkSession, d: str, name: str) -> float:
    """A setting of corpus_plan, a table of one row a setting."""
    return table(spark, d, "corpus_plan", "setting", "amount").where(F.col("setting") == name).first()["amount"]


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of all documents, written once: what follows reads them several times."""
    return cut_lineage(sized_texts(table(spark, d, "documents", "doc_id", "source", "text"), "doc_id", "source", "text"))


def _packed(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, int]:
    capacity = int(setting(spark, d, name))
    return pack(sized_documents(spark, d), "doc_id", "source", capacity), capacity


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "pack_capacity")[0].where("piece = 1").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "pack_capacity")[0]


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sequences(*_packed(spark, d, "pack_capacity"))


def p8_sequences_small(spark: SparkSession, d: str) -> DataFrame:
    return sequences(*_packed(spark, d, "pack_capacity_small"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = sized_documents(spark, d)
    targets = table(spark, d, "mix_target", "source", "weight", "max_repeats")
    return sized, mixture_plan(sized, "source", targets, setting(spark, d, "mix_budget_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(_mixture(spark, d)[1]).where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(_mixture(spark, d)[1])


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    sized, plan = _mixture(spark, d)
    return mixture(sized, "doc_id", "source", plan)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return sentence_units(rows, "doc_id", "text", train_on(rows, "text"))


QUERIES = {
    "p4_found": p4_found, "p4_segments": p4_segments, "p5_found": p5_found, "p5_mapped": p5_mapped, "p6_found": p6_found, "p6_cleaned": p6_cleaned,
    "p7_found": p7_found, "p7_groups": p7_groups,
    "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_sequences": p8_sequences, "p8_sequences_small": p8_sequences_small,
    "p9_found": p9_found, "p9_shares": p9_shares, "p9_documents": p9_documents, "p10_found": p10_found,
}

_REPEATED = r"""
WITH v AS (SELECT id, any_value(company_id) AS company_id, any_value(description) AS description FROM vacancy GROUP BY id),
s AS (SELECT v.id, coalesce('s' || c.slug, 'b' || v.company_id) AS slug, v.description FROM v LEFT JOIN company c ON c.id = v.company_id),
l AS (SELECT id, slug, unnest(string_split(description, chr(10))) AS line, generate_subscripts(string_split(description, chr(10)), 1) AS line_no FROM s),
k AS (SELECT id, slug, line, line_no, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS letters FROM l),
f AS (SELECT slug, letters FROM k WHERE length(letters) >= 25 GROUP BY slug, letters
      HAVING count(DISTINCT id) >= 8 AND count(DISTINCT id) >= 0.1 * (SELECT count(*) FROM s s2 WHERE s2.slug = k.slug))
"""

ORACLES = {
    # all pairs that share an item, by brute force
    "p7_found": r"""WITH v AS (SELECT id, any_value(title) AS title, any_value(location) AS location, any_value(description) AS description FROM vacancy GROUP BY id),
        t AS (SELECT id, trim(regexp_replace(lower(coalesce(title, '') || chr(10) || coalesce(location, '') || chr(10) || description), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS t FROM v WHERE length(description) >= 200),
        s AS (SELECT DISTINCT id, hash(substr(t, i, 8)) AS s FROM (SELECT id, t, unnest(range(1, length(t) - 6)) AS i FROM t)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
        SELECT a AS vacancy_id_a, b AS vacancy_id_b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.65 * (x.n + y.n - c)""",
    "p6_found": _REPEATED + "SELECT k.id AS vacancy_id, k.line_no FROM k JOIN f USING (slug, letters)",
    "p6_cleaned": _REPEATED + """, gone AS (SELECT k.id, k.line_no FROM k JOIN f USING (slug, letters)),
        hit AS (SELECT DISTINCT id FROM gone)
        SELECT v.id AS vacancy_id, CASE WHEN hit.id IS NULL THEN v.description ELSE coalesce(r.text, '') END AS description
        FROM v LEFT JOIN hit ON hit.id = v.id LEFT JOIN (
          SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text FROM l ANTI JOIN gone g ON g.id = l.id AND g.line_no = l.line_no GROUP BY l.id) r
        ON r.id = v.id""",
}
