"""Text rules as column expressions: cleaning, folding, tokens, language.

All of them stay in the JVM, so they run inside whole-stage code generation. A null text gives null
unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = r"[\p{L}\p{N}]"

# Seniority words, in the order in which they are looked for.
SENIORITY = [("MID", r"semi[\s-]?senior|ssr"), ("SENIOR", "senior|sr"), ("JUNIOR", "junior|jr"), ("PRINCIPAL", "principal")]

# Words that carry grammar, by kind: articles and joining words, pronouns, forms of be, have and can, prepositions, others.
FUNCTION_WORDS = {
    "da": "en et og men eller fordi når at vi du han hun dem deres vores jeres er var har bliver kan skal på af til fra med uden mellem hos ikke også meget som det den".split(),
    "de": "der die das ein eine einen und aber oder weil wenn dass ich wir sie ihr uns unser ihre ist sind wird werden kann haben mit nach bei aus durch für ohne über zum zur nicht auch sehr".split(),
    "en": "a an the and but because although while than he she they them their which who it its is are was were been has had does would could should from about into between through without with".split(),
    "es": "el los las una unos pero porque cuando aunque nosotros ellos usted sus nuestro nuestra es son está están ser hay tiene del al con desde hasta sin sobre entre para por muy también más".split(),
    "fi": "ja mutta tai koska kun jos että minä sinä hän me te he meidän sinun on ovat oli olla voi olet kanssa ilman kautta sekä ei myös hyvin joka jotka tämä se niin".split(),
    "fr": "le les une des mais parce quand donc où nous vous ils elle leur leurs notre votre est sont être avoir ont avez dans chez avec sans sous vers depuis pour très aussi plus cette ces".split(),
    "it": "gli una uno ma perché quando anche oppure noi loro suo sua nostro nostra è sono essere avere hanno della degli nella nelle dal sul con senza tra per molto più questo questa".split(),
    "nl": "het een maar omdat wanneer dus wij jij zij hun ons onze jouw zijn was wordt worden heeft hebben kunt van voor naar met door zonder tussen bij niet ook zeer deze dit".split(),
    "no": "en et ei og men eller fordi når at vi du han hun dem deres vår våre er var har blir kan skal på av til fra med uten mellom hos ikke også mye som det den".split(),
    "pl": "i ale oraz lub ponieważ my wy oni nas nasz nasza jego jest są był być ma mają w z na do dla przez pod przy bez między nie się także bardzo który która które to".split(),
    "pt": "os uma umas mas porque quando também nós eles você seu sua nosso nossa são foi está estão ser tem têm do da dos das no na nos nas pelo pela com sem até não".split(),
    "sv": "en ett och men eller eftersom när att vi du han hon dem deras vår vårt är var har blir kan ska på av till från med utan mellan för hos inte också mycket som det den".split(),
}
# A language for each script that only one of those here is written in.
SCRIPT_LANGUAGES = {"ko": "IsHangul", "he": "IsHebrew", "el": "IsGreek", "ar": "IsArabic", "th": "IsThai", "hi": "IsDevanagari", "ru": "IsCyrillic"}
UKRAINIAN_LETTERS = "іїєґ"
LEAST_LETTERS, SCRIPT_SHARE, LEAST_WORDS = 20, 0.2, 3


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def spaced(text: Column) -> Column:
    """Runs of ASCII white space as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    """What equality of free text goes by: any white space as one blank, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def name_form(name: Column) -> Column:
    """The key of a name: lower case, each inner run of blanks, underscores, slashes and hyphens one blank."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)(?<=[^\s_/-])[\s_/-]+(?=[^\s_/-])", " ")


def without_gender_marker(title: Column) -> Column:
    """A title without markers such as (m/w/d) or m/f/x that name m, w, f or h; others stay."""
    one = "(?:gn|[mwdfhxvikn])"
    bracketed = rf"(?i)[(\[](?=[^)\]]*\b[mwfh]\b)\s*{one}(?:\s*[/|,*+.\s]\s*{one})*\s*[)\]]"
    slashed = rf"(?i)(?<![\w/])(?=(?:\w+\s*/\s*)*[mwfh]\b){one}(?:\s*/\s*{one})+(?![\w/])"
    return F.regexp_replace(F.regexp_replace(title, bracketed, " "), slashed, " ")


def title_characters(title: Column) -> Column:
    """Letters and digits, and the signs of names like .net, C#, C++ and R&D; anything else is a blank."""
    other = rf"[^\p{{L}}\p{{N}}.#+&]|\.(?!{_EDGE})|(?<!{_EDGE})#|(?<![\p{{L}}\p{{N}}+])\+|&(?!{_EDGE})|(?<!{_EDGE})&"
    return spaced(F.regexp_replace(title, other, " "))


def seniority_words(title: Column) -> tuple[Column, Column]:
    """The levels a title names, each once, and the title without those words.

    A word found is removed before the next one is looked for.
    """
    levels, rest = [], title
    for level, words in SENIORITY:
        pattern = rf"(?i)(?<!{_EDGE})(?:{words})(?!{_EDGE})\.?"
        levels.append(F.when(rest.rlike(pattern), F.lit(level)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.array_compact(F.array(*levels)), spaced(rest)


def clean_title(title: Column) -> Column:
    """A title without gender marker, seniority words and stray signs; null is empty."""
    plain = title_characters(without_gender_marker(F.coalesce(title, F.lit(""))))
    return title_characters(seniority_words(plain)[1])


def clean_description(text: Column) -> Column:
    """Lines of letters, digits, marks, punctuation and currency, math and modifier signs, single-spaced; empty lines go."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}\p{P}\p{Sc}\p{Sm}\p{Sk}\n\r]|[︀-️]|[\x{E0100}-\x{E01EF}]", " ")
    lines = F.transform(F.split(kept, r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits with the signs . + # & between or after them."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[.&'-][\p{L}\p{N}]+)*[+#]*"), F.lit(0)), F.lower)


def bag_of_words(text: Column) -> Column:
    """The distinct words of a text in order of the alphabet, which equal bags share."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))), " ")


def _letters(text: Column, script: str = "L") -> Column:
    return F.length(F.regexp_replace(text, rf"[^\p{{{script}}}]", ""))


def script_language(text: Column) -> Column:
    """The language that the script of a text tells, with at least 20 letters; else null."""

    def tell(letters: Column) -> Column:
        n = F.length(letters)
        share = lambda x: x >= n * SCRIPT_SHARE
        kana, han = _letters(letters, "IsHiragana") + _letters(letters, "IsKatakana"), _letters(letters, "IsHan")
        counts = F.array(*(F.struct(_letters(letters, script).alias("n"), F.lit(code).alias("code")) for code, script in SCRIPT_LANGUAGES.items()))

        def other(most: Column) -> Column:
            code = F.when((most["code"] == "ru") & F.lower(letters).rlike(f"[{UKRAINIAN_LETTERS}]"), "uk").otherwise(most["code"])
            return F.when(share(most["n"]) & (most["n"] > 0), code)

        eastern = F.when((kana > 0) & (share(kana) | share(kana + han)), "ja").when(share(han) & (han > 0), "zh")
        return F.when((n < LEAST_LETTERS) | ~letters.rlike(r"[^\p{IsLatin}]"), None).otherwise(F.coalesce(F.when(letters.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"), eastern), bound(F.array_max(counts), other)))

    return bound(F.regexp_replace(text, r"[^\p{L}]", ""), tell)


def word_language(text: Column) -> Column:
    """The language with the most function words in a text, at least 3 and more than any other; else null."""
    listed = sorted({w for words in FUNCTION_WORDS.values() for w in words})

    def hits(words: Column, own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    def counts(words: Column) -> Column:
        return F.sort_array(F.array(*(F.struct(hits(words, own).alias("n"), F.lit(code).alias("code")) for code, own in FUNCTION_WORDS.items())), asc=False)

    def best(ranked: Column) -> Column:
        first, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
        return F.when((first["n"] >= LEAST_WORDS) & (first["n"] > second["n"]), first["code"])

    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*listed))
    return F.when(_letters(text) >= LEAST_LETTERS, bound(bound(words, counts), best))


def detected_language(declared: Column, text: Column) -> Column:
    """The language of a text where none is declared; null where one is."""
    return F.when(declared.isNull(), F.coalesce(script_language(text), word_language(text)))


def simple_sentences(text: Column, abbreviations: tuple[str, ...] = ("e.g.", "i.e.", "etc.", "Dr.", "Mr.", "Mrs.", "Ms.", "St.", "Inc.", "Ltd.")) -> Column:
    """Sentences of one line: cut after . ! or ? before a capital, digit or opening sign, unless an abbreviation ends there."""
    spared = reduce(lambda p, a: p + rf"(?<!\b{a.replace('.', '[.]')})", abbreviations, "")
    return F.filter(F.split(text, rf"(?<=[.!?]){spared}(?<!\b\p{{L}}[.])\s+(?=[\p{{Lu}}\p{{N}}\"“(])"), lambda x: x != "")


def is_heading(line: Column, nouns: tuple[str, ...] = ("requirements", "benefits", "responsibilities", "team", "role")) -> Column:
    """A short line of one sentence that ends with a colon, is all capitals, or names a part of a posting."""
    words = F.split(F.lower(F.regexp_replace(line, r":$", "")), r"\s+")
    noun = F.element_at(words, 1).isin(*nouns) | F.element_at(words, -1).isin(*nouns)
    capitals = (line == F.upper(line)) & (_letters(line) >= 4)
    return (F.length(line) <= 60) & ~line.rlike(r"[.!?]\s*$") & (line.rlike(r":\s*$") | capitals | ((F.size(words) <= 4) & noun))


def title_parts(title: Column) -> Column:
    """Parts of a title between commas, semicolons, bars, brackets, colons and spaced dashes."""
    return F.filter(F.transform(F.split(title, r"[,;|()\[\]{}:]|\s[-–—]\s"), lambda x: F.trim(x)), lambda x: x != "")


# Letters without a decomposition and what they are folded to.
UNDECOMPOSED = {"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae"}


@F.pandas_udf(T.StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    plain = texts.str.lower().str.normalize("NFD").str.replace(r"[̀-ͯ'’]", "", regex=True)
    for letter, folded_letter in UNDECOMPOSED.items():
        plain = plain.str.replace(letter, folded_letter, regex=False)
    return plain


def accent_folded(text: Column) -> Column:
    """Lower case without marks and apostrophes; Spark has no decomposition, so this is an Arrow function."""
    return _without_marks(text)


def guessed_items(line: Column, starts: tuple[str, ...] = ("You", "We", "Experience", "Ability", "Knowledge", "Build", "Work", "Lead")) -> Column:
    """Items run together on one line: cut at a blank between a small letter, digit or bracket and a word that items begin with."""
    return F.filter(F.split(line, rf"(?<=[\p{{Ll}}\p{{N}})])\s+(?=(?:{'|'.join(starts)})\b)"), lambda x: x != "")


def first_reason(text: Column, reasons: dict[str, str]) -> Column:
    """The reason whose pattern matches earliest in a text; of equals the first listed; null if none matches."""
    at = F.array(*(F.struct(F.when(text.rlike(p), F.length(F.regexp_extract(text, rf"(?s)^(.*?)(?:{p})", 1))).alias("at"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, (r, p) in enumerate(reasons.items())))
    return F.array_min(F.filter(at, lambda x: x["at"].isNotNull()))["r"]
