"""What titles and postings say: rank, modes of work, years asked for, a normal title."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import clean_title, title_parts

# Words of ranks from the lowest to the highest, of modes from the most open one, and
# numbers written out.
RANKS = {"LEAD": "lead|leitung|responsable", "MANAGER": "manager|head", "DIRECTOR": "director|vp", "EXECUTIVE": "chief|ceo|cto|cfo"}
MODES = {"REMOTE": r"remote|home office|anywhere|worldwide", "HYBRID": r"hybrid|\d+ days? on-?site", "ONSITE": r"on-?site|in office|customer site|field based"}
NUMBERS = "one two three four five six seven eight nine ten".split()
MOST_YEARS = 25


def _word(words: str) -> str:
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


def management_level(title: Column) -> Column:
    """The highest rank a title names, or null."""
    level = F.lit(None).cast("string")
    for name, words in RANKS.items():
        level = F.when(title.rlike(_word(words)), name).otherwise(level)
    return level


def named_modes(text: Column) -> Column:
    """The modes of work a text names, the most open one first; of a null text, none."""
    return F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(_word(words)), mode) for mode, words in MODES.items())))


def first_evidence(**sources: Column) -> tuple[Column, Column]:
    """The modes of the first source that names any, and that source's name; empty and NONE if none does."""
    modes, name = F.array().cast("array<string>"), F.lit("NONE")
    for source, found in reversed(sources.items()):
        modes, name = F.when(F.size(found) > 0, found).otherwise(modes), F.when(F.size(found) > 0, source.upper()).otherwise(name)
    return modes, name


def years_asked(text: Column) -> Column:
    """The years of experience a text asks for: of each phrase the least number, of the phrases the greatest.

    A phrase is a number or a range of digits or words before "years" or "yrs", not behind a currency
    sign or within a word, and of at most 25 years. Null if there is none.
    """
    number = r"(?:\d{1,2}|" + "|".join(NUMBERS) + ")"
    phrase = rf"(?i)(?<![\w$€£.,])({number})(?:\s*(?:-|–|to|or)\s*{number})?\s*\+?\s*(?:or more\s+)?(?:years?|yrs?)\b"
    words = F.create_map(*(F.lit(x) for i, w in enumerate(NUMBERS, 1) for x in (w, i)))
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(phrase), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), words[x]))
    return F.array_max(F.filter(found, lambda x: x <= MOST_YEARS))


def level_of(named: Column, years: Column) -> Column:
    """The level a title names, or else the one of the years asked for."""
    by_years = F.when(years <= 1, "ENTRY").when(years == 2, "JUNIOR").when(years <= 4, "MID").when(years <= 7, "SENIOR").when(years >= 8, "STAFF")
    return F.coalesce(named, by_years)


def lowest_level(levels: Column, ladder: Sequence[str] = ("ENTRY", "JUNIOR", "MID", "SENIOR", "STAFF", "PRINCIPAL")) -> Column:
    """The lowest of some levels on the ladder; those off it don't count."""
    ranks = F.create_map(*(F.lit(x) for i, level in enumerate(ladder) for x in (level, i)))
    return F.get(F.lit(list(ladder)), F.array_min(F.transform(levels, lambda x: ranks[x])))


def normal_title(title: Column) -> Column:
    """The first part of a title, cleaned and in lower case, without numbers and codes."""
    first = F.get(title_parts(F.coalesce(title, F.lit(""))), F.lit(0))
    words = F.filter(F.split(F.lower(clean_title(first)), " "), lambda w: (w != "") & ~w.rlike(r"^\d") & ~w.rlike(r"^(?:[ivx]+|lead|staff|new|urgent)$"))
    return F.array_join(words, " ")


def role_of(title: Column, listed: Mapping[str, str], heads: Mapping[str, str]) -> Column:
    """The role of a normal title: as listed, or else by its last word that is a head; null if neither."""
    pairs = lambda m: F.create_map(*(F.lit(x) for item in m.items() for x in item))
    words = F.split(title, " ")
    named = F.filter(words, lambda w: w.isin(*heads))
    return F.coalesce(pairs(listed)[title], pairs(heads)[F.get(named, F.size(named) - 1)])
