"""Names that texts mention and no list holds yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = r"\p{L}[\p{L}\p{N}+#.-]*"


def word_evidence(df: DataFrame, ident: str, company: str, text: str) -> DataFrame:
    """``word, n_docs, n_companies, n_capitalised, n_plain``: how the texts write each word.

    A word counts as capitalised where it begins with a capital and isn't the first of its sentence.
    Counts of documents and companies come from distinct (word, document) rows, hashed on both, so a
    word of all documents is counted by partial sums.
    """
    cut = F.explode(F.split(F.col("_text"), r"(?<=[.!?])\s+|\n")).alias("_s")
    rows = df.select(F.col(ident).alias("_id"), F.col(company).alias("_c"), F.col(text).alias("_text")).where("_text is not null")
    words = rows.select("_id", "_c", cut).select("_id", "_c", F.posexplode(F.regexp_extract_all("_s", F.lit(_WORD), F.lit(0))).alias("_at", "_w"))
    clean = words.select("_id", "_c", "_at", F.regexp_replace("_w", r"[.-]+$", "").alias("_w"))
    upper = F.col("_w").rlike(r"^\p{Lu}")
    per = clean.groupBy(F.lower("_w").alias("word"), "_id").agg(
        F.first("_c").alias("_c"), F.count_if(upper & (F.col("_at") > 0)).alias("_up"), F.count_if(~upper).alias("_low")
    )
    by_company = per.groupBy("word", "_c").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_up").alias("_up"), F.sum("_low").alias("_low"))
    return by_company.groupBy("word").agg(F.sum("_docs").alias("n_docs"), F.count("_c").alias("n_companies"), F.sum("_up").alias("n_capitalised"), F.sum("_low").alias("n_plain"))


def name_candidates(evidence: DataFrame, known: DataFrame, least_companies: int = 3, least_capitalised: float = 0.7) -> DataFrame:
    """Words that several companies write with a capital within sentences, and that aren't known."""
    share = F.col("n_capitalised") / (F.col("n_capitalised") + F.col("n_plain"))
    rows = evidence.where((F.col("n_companies") >= least_companies) & (F.col("n_capitalised") > 0) & (share >= least_capitalised))
    return rows.join(known.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").withColumn("capitalised", F.round(share, 6))


def words_nearby(df: DataFrame, ident: str, text: str, reach: int) -> DataFrame:
    """``word, near_word, n_docs``: words that stand at most ``reach`` words apart, in how many texts.

    Each word is joined with its text's own array of words, so a word never meets another text's.
    """
    words = df.select(F.col(ident).alias("_id"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0)).alias("_w"))
    at = words.select("_id", "_w", F.posexplode("_w").alias("_i", "word"))
    near = at.select("_id", "word", F.explode(F.slice("_w", F.col("_i") + 2, F.lit(reach))).alias("near_word")).where("word <> near_word")
    pair = near.select("_id", F.least("word", "near_word").alias("word"), F.greatest("word", "near_word").alias("near_word")).distinct()
    return pair.groupBy("word", "near_word").agg(F.count(F.lit(1)).alias("n_docs"))


def first_mentions(df: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    """``ident, line_no, line``: the first line of each text that mentions a name, its parts joined by blanks, hyphens, slashes or nothing."""
    import re

    pattern = r"(?i)(?<![\p{L}\p{N}])" + r"[\s/_-]*".join(map(re.escape, re.split(r"[\s/_-]+", name.strip()))) + r"(?![\p{L}\p{N}])"
    lines = df.select(ident, F.posexplode(F.split(text, "\n")).alias("_at", "line")).where(F.col("line").rlike(pattern))
    return lines.groupBy(ident).agg(F.min(F.struct((F.col("_at") + 1).alias("n"), "line")).alias("_f")).select(ident, F.col("_f.n").alias("line_no"), F.col("_f.line").alias("line"))
