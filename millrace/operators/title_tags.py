"""Titles tagged by a vocabulary and composed anew.

The vocabulary and the respellings are parameters. Distinct titles are tagged, a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import title_parts
from millrace.functions.titles import role_of

HEAD, AREA, KIND, RANK, LEVEL, NOISE = "HEAD", "AREA", "KIND", "RANK", "LEVEL", "NOISE"
#: Words that put the area behind a head.
LEADING = ("of", "for")


@dataclass(frozen=True)
class Vocabulary:
    """Phrases with their tag, respellings of words and of pairs of words, and titles that are replaced as a whole."""

    tags: Mapping[str, str] = field(default_factory=dict)
    respelled: Mapping[str, str] = field(default_factory=dict)
    whole: Mapping[str, str] = field(default_factory=dict)

    def respell(self, words: list[str]) -> list[str]:
        """Each pair that has another spelling replaced, and each word that is in no such pair."""
        out: list[str] = []
        queue = list(reversed(words))
        while queue:
            word = queue.pop()
            pair = self.respelled.get(f"{word} {queue[-1]}") if queue else None
            if pair is not None:
                queue.pop()
            out += (pair if pair is not None else self.respelled.get(word, word)).split()
        return out

    def tagged(self, words: list[str], own: frozenset[str] = frozenset()) -> list[tuple[str, str | None]]:
        """Phrases with their tags from the left, at each place the longest; a phrase of ``own`` is noise, other words have none."""
        longest = max((p.count(" ") + 1 for p in (*self.tags, *own)), default=1)
        out: list[tuple[str, str | None]] = []
        at = 0
        while at < len(words):
            runs = (" ".join(words[at : at + n]) for n in range(min(longest, len(words) - at), 0, -1))
            phrase = next((r for r in runs if r in own or r in self.tags), None)
            tag = None if phrase is None else NOISE if phrase in own else self.tags[phrase]
            out.append((phrase or words[at], tag))
            at += len(out[-1][0].split())
        return out


def head_of(tags: list[tuple[str, str | None]]) -> int | None:
    """Where the head is: an earlier one that leads an area (head of data) before the last one; none without."""
    heads = [i for i, (_, tag) in enumerate(tags) if tag == HEAD]
    leading = [i for i in heads if [p for p, _ in tags[i + 1 : i + 2]] and tags[i + 1][0] in LEADING and any(tag == AREA for _, tag in tags[i + 2 : i + 4])]
    return leading[0] if leading else heads[-1] if heads else None


def composed(tags: list[tuple[str, str | None]]) -> str | None:
    """Areas, then kinds, then the head, each word once; null without a head."""
    at = head_of(tags)
    if at is None:
        return None
    words = [w for wanted in (AREA, KIND) for phrase, tag in tags if tag == wanted for w in phrase.split()]
    return " ".join(dict.fromkeys(w for w in [*words, *tags[at][0].split()]))


def titles_of(parts: list[str], vocabulary: Vocabulary, own: frozenset[str] = frozenset()) -> list[str]:
    """Up to two titles of the parts of a title: one of each part that has a head, areas and kinds of headless parts going to the first.

    A slash joins two heads; a whole title that is listed is replaced first.
    """
    if (given := vocabulary.whole.get(" ".join(" ".join(parts).split()))) is not None:
        return [given]
    found: list[list[tuple[str, str | None]]] = []
    loose: list[tuple[str, str | None]] = []
    for part in parts:
        for side in re.split(r"\s*/\s*", part):
            tags = vocabulary.tagged(vocabulary.respell(side.split()), own)
            if head_of(tags) is None:
                loose += [x for x in tags if x[1] in (AREA, KIND)]
            else:
                found.append(tags)
    if found:
        found[0] = loose + found[0]
    return list(dict.fromkeys(t for t in map(composed, found) if t))[:2]


def normalised_titles(df: DataFrame, title: str, vocabulary: Vocabulary, own: Column | None = None) -> DataFrame:
    """``df`` with ``titles``, the titles composed of each one: none, one or two.

    ``own`` are phrases of the row itself (its places and topics, in lower case) that count as noise.
    Null and blank titles have none. Equal (title, own) are composed once.
    """
    own = F.lit(None).cast("array<string>") if own is None else F.array_sort(F.array_distinct(own))
    keyed = df.withColumn("_own", own)
    rows = keyed.select(F.col(title).alias("_title"), F.col("_own").alias("_o")).where("trim(_title) <> ''").distinct().withColumn("_parts", title_parts(F.lower("_title")))

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = [frozenset(o) if o is not None else frozenset() for o in frame["_o"]]
            frame["titles"] = [titles_of(list(p), vocabulary, o) for p, o in zip(frame["_parts"], given, strict=True)]
            yield frame[["_title", "_o", "titles"]]

    made = rows.mapInPandas(compose, "_title string, _o array<string>, titles array<string>")
    joined = keyed.join(made, (F.col(title) == F.col("_title")) & F.col("_own").eqNullSafe(F.col("_o")), "left")
    return joined.select(*(keyed[c] for c in df.columns), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def roles_of(titles: Column, listed: Mapping[str, str], heads: Mapping[str, str], none: str = "none") -> Column:
    """The distinct roles of some titles in their order, without ``none``."""
    return F.array_distinct(F.filter(F.transform(titles, lambda t: role_of(t, listed, heads)), lambda r: r.isNotNull() & (r != none)))
