"""Dictionaries of phrases matched against texts.

The dictionaries are parameters. Phrases are found by a join: the distinct texts give their runs of
words, and those that a dictionary lists meet it on the run. Mentions in whole documents go by a
matcher, which is built once a task from a broadcast list and runs over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import name_form


def dictionary(spark: SparkSession, kinds: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """``kind, phrase, label`` of several dictionaries, each a mapping of phrases to labels."""
    rows = [(kind, phrase, label) for kind, phrases in kinds.items() for phrase, label in phrases.items()]
    given = spark.createDataFrame(rows, "kind string, phrase string, label string")
    return given.select("kind", name_form(F.col("phrase")).alias("phrase"), "label").where("phrase <> ''")


def phrase_hits(df: DataFrame, text: str, phrases: DataFrame, longest: int | None = None) -> DataFrame:
    """``text, kind, phrase, label, size, at``: each listed phrase in the words of each distinct text.

    ``phrases`` has ``kind, phrase, label``, the phrases as ``name_form`` gives them; of equal ones in
    a kind the least label counts. ``size`` is its number of words and ``at`` the place of the first,
    from 1. ``longest`` bounds the words of a phrase; without it the dictionary is asked. Null and
    blank texts have none. Either side may have any size: runs and phrases meet in a join.
    """
    listed = phrases.groupBy("kind", "phrase").agg(F.min("label").alias("label"))
    if longest is None:
        longest = listed.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    each = df.select(F.col(text).alias("_text")).where("trim(_text) <> ''").distinct().withColumn("_words", F.split(name_form(F.col("_text")), r"\s+"))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("_words") >= n, F.sequence(F.lit(1), F.size("_words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("_words", i, n), " ").alias("phrase")))

    runs = F.flatten(F.array(*map(runs_of, range(1, max(1, longest) + 1))))
    spread = each.select("_text", F.explode(runs).alias("r")).select("_text", "r.*")
    return spread.join(listed, "phrase").select(F.col("_text").alias(text), "kind", "phrase", "label", "size", "at")


def _longest(value: str) -> Column:
    """Of hits the value of the longest, of equals the first."""
    return F.max_by(value, F.struct(F.col("size"), -F.col("at")))


def phrase_labels(df: DataFrame, text: str, labels: Mapping[str, str], name: str = "label") -> DataFrame:
    """``df`` with the label of the longest phrase in a text's words, the first of equals, or null."""
    hits = phrase_hits(df, text, dictionary(df.sparkSession, {"all": labels}))
    found = hits.groupBy(F.col(text).alias("_text")).agg(_longest("label").alias(name))
    return df.join(found, F.col(text) == F.col("_text"), "left").drop("_text")


@dataclass
class Classifier:
    """Three states by dictionaries, in the order: rulings, never, disciplines, qualifiers, heads.

    A title ruled by name (the longest such phrase) has that state. Else a word of ``heads`` is needed,
    or the title is unknown for want of a rule; ``never`` and ``disciplines`` put it out, a
    ``qualifier`` in; if the last of its heads needs a domain the title is unknown for its domain,
    else for its scope.
    """

    rulings: Mapping[str, str] = field(default_factory=dict)
    never: frozenset[str] = frozenset()
    disciplines: frozenset[str] = frozenset()
    qualifiers: frozenset[str] = frozenset()
    heads: Mapping[str, bool] = field(default_factory=dict)

    def classify(self, df: DataFrame, title: str) -> DataFrame:
        """``df`` with ``state`` and ``reason``. Null and blank titles are unknown for want of a rule."""
        kinds = {
            "ruling": self.rulings, "out": dict.fromkeys([*self.never, *self.disciplines], ""), "in": dict.fromkeys(self.qualifiers, ""),
            "head": {w: "DOMAIN_AMBIGUITY" if domain else "SCOPE_AMBIGUITY" for w, domain in self.heads.items()},
        }
        hits = phrase_hits(df, title, dictionary(df.sparkSession, kinds))
        of = lambda kind: F.col("kind") == kind
        found = hits.groupBy(F.col(title).alias("_text")).agg(
            F.max_by(F.when(of("ruling"), F.col("label")), F.when(of("ruling"), F.struct(F.col("size"), -F.col("at")))).alias("_ruled"),
            F.max_by(F.when(of("head"), F.col("label")), F.when(of("head"), F.col("at"))).alias("_head"),
            F.count_if(of("out")).alias("_out"), F.count_if(of("in")).alias("_in"),
        )
        ruled, head = F.col("_ruled").isNotNull(), F.col("_head").isNotNull()
        state = F.when(ruled, F.col("_ruled")).when(head & (F.col("_out") > 0), "OUT").when(head & (F.col("_in") > 0), "IN").otherwise("UNKNOWN")
        reason = F.when(ruled, None).when(~head, "UNRULED").when((F.col("_out") > 0) | (F.col("_in") > 0), None).otherwise(F.col("_head"))
        both = df.join(found, F.col(title) == F.col("_text"), "left")
        return both.select(*(both[c] for c in df.columns), state.alias("state"), reason.alias("reason"))


@dataclass
class Entry:
    ident: str
    keys: tuple[str, ...]
    context_keys: tuple[str, ...] = ()
    parent: str | None = None


#: Keys of a list of entries that is sent to all tasks.
MOST_KEYS = 1_000_000


class Matcher:
    """Finds the keys of entries in texts: whole words, the longest at each place, none overlapping.

    Plain keys match in any case, with blanks, hyphens, slashes and underscores alike. Context keys
    match only as written, and count only beside a plain mention of another entry in the same
    segment, or of the entry's parent or child anywhere in the document. Addresses are passed over.
    """

    _SKIPPED = re.compile(r"\b(?:https?://|www\.)\S+|\S+@\S+\.\w+")
    _WORD = re.compile(r"\w+[+#]*")

    def __init__(self, entries: Iterable[Entry]):
        self.entries = {e.ident: e for e in entries}
        self.plain: dict[tuple[str, ...], str] = {}
        self.exact: dict[tuple[str, ...], str] = {}
        for e in self.entries.values():
            for key in e.keys:
                self.plain.setdefault(self._words(key.lower()), e.ident)
            for key in e.context_keys:
                self.exact.setdefault(self._words(key), e.ident)
        self.longest = max((len(k) for k in [*self.plain, *self.exact]), default=0)
        self.first = {k[0] for k in self.plain if k} | {k[0].lower() for k in self.exact if k}

    def _words(self, text: str) -> tuple[str, ...]:
        return tuple(self._WORD.findall(text))

    def mentions(self, text: str) -> Iterator[tuple[str, bool]]:
        """Entry and whether by a context key, in order."""
        words = self._words(self._SKIPPED.sub(" \n ", text))
        small = tuple(w.lower() for w in words)
        at = 0
        while at < len(words):
            step = 1
            if small[at] in self.first:
                for size in range(min(self.longest, len(words) - at), 0, -1):
                    if (ident := self.plain.get(small[at : at + size])) is not None:
                        yield ident, False
                        step = size
                        break
                    if (ident := self.exact.get(words[at : at + size])) is not None:
                        yield ident, True
                        step = size
                        break
            at += step

    def found(self, segments: list[str]) -> dict[str, tuple[list[int], bool]]:
        """Of each entry found the segments that mention it, and whether only context keys do."""
        plain: dict[str, set[int]] = {}
        context: dict[str, set[int]] = {}
        for number, text in enumerate(segments):
            for ident, by_context in self.mentions(text or ""):
                (context if by_context else plain).setdefault(ident, set()).add(number)
        related = {e.parent for i, e in self.entries.items() if i in plain} | {e.ident for e in self.entries.values() if e.parent in plain}
        out = {i: (sorted(s), False) for i, s in plain.items()}
        for ident, where in context.items():
            sure = {n for n in where if ident in related or any(n in s for i, s in plain.items() if i != ident)}
            if sure:
                before, only = out.get(ident, ([], True))
                out[ident] = (sorted({*before, *sure}), only)
        return out


def extract_entries(df: DataFrame, key: str, text: str, entries: Iterable[Entry]) -> DataFrame:
    """``key, entry, segments, from_context``: the entries each text mentions; segments are its lines from 0.

    Null and empty texts mention none. The list of entries is sent to all tasks with the code, so it is
    a reference list of at most MOST_KEYS keys; a longer one is an error.
    """
    given = list(entries)
    if sum(len(e.keys) + len(e.context_keys) for e in given) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    listed = df.sparkSession.sparkContext.broadcast(given)
    kind = df.schema[key].dataType.simpleString()

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(listed.value)
        for frame in frames:
            rows = [(k, i, where, only) for k, t in zip(frame["_key"].tolist(), frame["_text"].tolist(), strict=True) if t for i, (where, only) in matcher.found(t.split("\n")).items()]
            yield pd.DataFrame(rows, columns=["_key", "entry", "segments", "from_context"])

    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInPandas(find, f"_key {kind}, entry string, segments array<int>, from_context boolean").withColumnRenamed("_key", key)


def extract_from_segments(df: DataFrame, key: str, title: str, segments: str, entries: Iterable[Entry]) -> DataFrame:
    """``key, entry, segments, from_context``: as ``extract_entries``, over a record's title and segments.

    ``segments`` is a column as ``operators.segments`` gives it. The title is segment -1; segments that
    are boilerplate are passed over, the others keep their number from 0. Null titles and arrays have
    no mentions. A record given twice counts once; its copies must agree.
    """
    numbered = F.filter(F.transform(F.col(segments), lambda s, i: F.struct(i.alias("n"), s["text"].alias("text"), F.coalesce(s["boilerplate"], F.lit(False)).alias("skip"))), lambda x: ~x["skip"])
    first = F.array(F.struct(F.lit(-1).alias("n"), F.coalesce(title, F.lit("")).alias("text"), F.lit(False).alias("skip")))
    pieces = F.concat(first, F.coalesce(numbered, F.array().cast("array<struct<n:int,text:string,skip:boolean>>")))
    joined = df.select(F.col(key), pieces.alias("_pieces")).dropDuplicates([key]).select(
        F.col(key), F.col("_pieces.n").alias("_numbers"), F.array_join(F.transform("_pieces.text", lambda t: F.translate(t, "\n", " ")), "\n").alias("_text")
    )
    found = extract_entries(joined, key, "_text", entries)
    numbers = joined.select(F.col(key).alias("_k"), "_numbers")
    both = found.join(numbers, F.col(key).eqNullSafe(F.col("_k")))
    return both.select(key, "entry", F.transform("segments", lambda i: F.get("_numbers", i)).alias("segments"), "from_context")
