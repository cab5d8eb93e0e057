"""Documents as ordered segments: headings, list items and sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "under", "text")] + [T.StructField("boilerplate", T.BooleanType())]))

_BULLET = re.compile(r"\s*(?:[-*•·▪◦–]|\d{1,2}[.)])\s+")
_INLINE = re.compile(r"\s+[•·▪◦]\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"“(]?[A-ZÀ-Þ0-9])")
_SPARED = re.compile(r"(?:\b(?:e\.g|i\.e|etc|dr|mr|mrs|ms|prof|st|inc|ltd|vs|no|approx)|\b\w)\.$", re.IGNORECASE)
_NOUNS = {"requirements", "responsibilities", "benefits", "qualifications", "skills", "team", "role", "about", "duties", "perks", "offer"}


def _sentences(text: str) -> list[str]:
    out: list[str] = []
    for piece in _SENTENCE.split(text):
        if out and _SPARED.search(out[-1]):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [x.strip() for x in out if x.strip()]


def _heading(text: str, phrases: frozenset[str]) -> bool:
    if text.lower().rstrip(": ") in phrases:
        return True
    if len(text) > 60 or re.search(r"[.!?;,]\s*$", text):
        return False
    words = re.findall(r"\w+", text.lower())
    letters = sum(map(str.isalpha, text))
    return text.rstrip().endswith(":") or (text.isupper() and letters >= 4) or bool(words and len(words) <= 4 and (words[0] in _NOUNS or words[-1] in _NOUNS))


def _guessed(text: str, starts: tuple[str, ...]) -> list[str]:
    """A text cut before each of ``starts`` that follows a small letter, a digit or a closing bracket."""
    return re.split(rf"(?<=[^\W_A-Z])\s+(?=(?:{'|'.join(map(re.escape, starts))})\b)|(?<=\))\s+(?=(?:{'|'.join(map(re.escape, starts))})\b)", text) if starts else [text]


def split_segments(text: str | None, phrases: frozenset[str] = frozenset(), starts: tuple[str, ...] = ()) -> list[tuple[str, str | None, str, bool]]:
    """Rows (kind, heading above, text, boilerplate) of a text with marked lines.

    A line may begin with ``> `` (boilerplate) and then ``# `` (heading) or ``- `` (item); unmarked
    lines are bulleted or numbered items, headings by their looks, or sentences. A heading holds for
    what follows until the next one, or until boilerplate begins or ends. ``phrases`` are headings by
    themselves (in lower case). In a text of one line, sentences that hold items run together are cut
    before the words of ``starts``: what follows the first cut are items.
    """
    one_line = len([x for x in (text or "").splitlines() if x.strip()]) == 1
    out: list[tuple[str, str | None, str, bool]] = []
    under, was = None, False
    for line in (text or "").splitlines():
        boiler = line.startswith("> ")
        body = line[2:] if boiler else line
        if boiler != was:
            under, was = None, boiler
        if not body.strip():
            continue
        if body.startswith("# "):
            under = body[2:].strip()
            out.append(("HEADING", None, under, boiler))
            continue
        marked = _BULLET.match(body)
        if marked:
            for item in _INLINE.split(body[marked.end() :]):
                if item.strip():
                    out.append(("ITEM", under, item.strip(), boiler))
            continue
        first, *items = _INLINE.split(body)
        first = first.strip()
        if _heading(first, phrases):
            under = first
            out.append(("HEADING", None, first, boiler))
        else:
            for sentence in _sentences(first):
                whole, *run_on = _guessed(sentence, starts if one_line else ())
                out.append(("SENTENCE", under, whole, boiler))
                out += [("ITEM", under, x, boiler) for x in run_on]
        out += [("ITEM", under, x.strip(), boiler) for x in items if x.strip()]
    return out


def segments(text: Column, phrases: frozenset[str] = frozenset(), starts: tuple[str, ...] = ()) -> Column:
    """The segments of a text as an array of structs, as ``split_segments`` has them; of a null text, none."""

    @F.pandas_udf(SEGMENTS)
    def split(texts: pd.Series) -> pd.Series:
        names = ("kind", "under", "text", "boilerplate")
        return texts.map(lambda t: [dict(zip(names, row, strict=True)) for row in split_segments(t, phrases, starts)])

    return split(text)


def marked(segment: Column) -> Column:
    """A segment as a marked line again."""
    sign = F.when(segment["kind"] == "HEADING", "# ").when(segment["kind"] == "ITEM", "- ").otherwise("")
    return F.concat(F.when(segment["boilerplate"], "> ").otherwise(""), sign, segment["text"])


def neighbour(items: Column, index: Column, step: int) -> Column:
    """The element ``step`` places from ``index``, or null beyond either end."""
    return F.get(items, index + F.lit(step))
