"""Lines that one source repeats across its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def line_letters(line: Column) -> Column:
    """What two lines are compared by: their letters (Unicode category L), lower-cased."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def repeated_lines(
    documents: DataFrame, doc: str, board: str, text: str, source_of: DataFrame, source: str,
    least_letters: int = 25, least_documents: int = 8, least_share: float = 0.1,
) -> DataFrame:
    """The lines to remove: ``doc, line_no`` (from 1), one row each.

    ``source_of`` maps each ``board`` to its ``source``; boards of one source count together, and a
    board it lacks is a source of its own. Lines are the pieces between line feeds, blank ones
    included; one with fewer than ``least_letters`` letters never counts. A line is removed if it
    occurs in at least ``least_documents`` documents of its source and in at least ``least_share``
    of them, documents without text included.

    A document given twice counts once, by its id; its rows must agree in board and text. Null and
    empty texts have no line that counts. Extra columns are not read.

    Plan: lines shrink to a 64-bit hash in the scan's stage, so texts are read once and never
    shuffled; the hashes are written and read by what follows. Distinct
    (board, hash, document) rows are counted by partial aggregates to (board, hash), and only those
    counts, written once, meet the boards' sources. The lines join the frequent hashes on (board, hash), which
    spreads the lines of one large source over all tasks.
    """
    rows = documents.select(F.col(doc).alias("_doc"), F.col(board).alias("_board"), F.col(text).alias("_text"))
    pieces = rows.select("_doc", "_board", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
    letters = pieces.select("_doc", "_board", (F.col("_at") + 1).alias("line_no"), line_letters(F.col("_line")).alias("_letters"))
    lines = cut_lineage(letters.where(F.length("_letters") >= least_letters).select("_doc", "_board", "line_no", F.xxhash64("_letters").alias("_hash")))

    sources = source_of.select(F.col(board).alias("_sboard"), F.col(source).alias("_source")).dropDuplicates(["_sboard"])
    same_board = F.col("_board").eqNullSafe(F.col("_sboard"))
    own = F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.concat(F.lit("b"), F.col("_board").cast("string")), F.lit("n"))
    per_board = rows.select("_doc", "_board").distinct().groupBy("_board").agg(F.count(F.lit(1)).alias("_docs"))
    boards = per_board.join(sources, same_board, "left").select("_board", "_docs", own.alias("_group"))
    totals = boards.groupBy("_group").agg(F.sum("_docs").alias("_total"))
    board_totals = boards.join(totals, "_group").select(F.col("_board").alias("_tboard"), "_group", "_total")

    counted = cut_lineage(lines.select("_doc", "_board", "_hash").distinct().groupBy("_board", "_hash").agg(F.count(F.lit(1)).alias("_n")))
    grouped = counted.join(board_totals, F.col("_board").eqNullSafe(F.col("_tboard"))).select("_board", "_hash", "_n", "_group", "_total")
    enough = (F.col("_all") >= least_documents) & (F.col("_all") >= F.lit(least_share) * F.col("_of"))
    keys = grouped.groupBy("_group", "_hash").agg(F.sum("_n").alias("_all"), F.max("_total").alias("_of")).where(enough).select("_group", "_hash")
    frequent = grouped.join(keys, ["_group", "_hash"]).select(F.col("_board").alias("_fboard"), F.col("_hash").alias("_fhash"))
    on = F.col("_board").eqNullSafe(F.col("_fboard")) & (F.col("_hash") == F.col("_fhash"))
    return lines.join(frequent, on, "left_semi").select(F.col("_doc").alias(doc), "line_no").distinct()


def without_lines(documents: DataFrame, doc: str, text: str, removed: DataFrame) -> DataFrame:
    """``doc`` and ``text`` of each document without its removed lines, the others untouched.

    ``removed`` has ``doc, line_no``. A document with no line removed, and a null text, stay as they
    are; a text all of whose lines go is empty. Copies of a document come out once.
    """
    gone = removed.groupBy(F.col(doc).alias("_gdoc")).agg(F.collect_set("line_no").alias("_gone"))
    once = documents.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).dropDuplicates(["_doc"])
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i + 1)), "\n")
    rebuilt = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept)
    return once.join(gone, F.col("_doc").eqNullSafe(F.col("_gdoc")), "left").select(F.col("_doc").alias(doc), rebuilt.alias(text))
