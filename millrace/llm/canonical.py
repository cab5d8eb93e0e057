"""Freely typed values mapped to the closest entry of a reference list.

A value has several readings, in the order to try. A reading that is a listed name is found by a
join; the names of the others are looked up in BK-trees under the unrestricted Damerau-Levenshtein
distance (insert, delete, replace, transpose). Unlike its restricted form it obeys the triangle
inequality, on which the pruning rests, so a tree returns every name within the threshold. There is
a tree for each length of names, since a name visits only lengths within the threshold of its own.
A reference list of bounded size is sent to all tasks as such trees. A longer one is cut into
shards, each of one length; each tree is built once, and each name goes to the shards it can match.
Either way all matches come back as rows, and the joins that follow decide, so the answer is one.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator, Mapping, Set
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage, rows_within

#: Edits allowed of a name, from what length one is, and from what length all are.
MOST_EDITS, LEAST_LENGTH, SECOND_EDIT = 2, 4, 6
#: Names in a leaf of a tree.
BUCKET = 32
#: Names of broadcast trees; a longer reference list goes by shards of this many.
MOST_NAMES = 50_000
#: Names looked up in a shard by one task.
MOST_ASKED = 2_000

# Letters that have no decomposition, short forms of words, and words that are said
# of a place beside its name.
UNDECOMPOSED = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
SHORT_FORMS = {"st": "saint", "st.": "saint", "ft": "fort", "ft.": "fort", "mt": "mount", "mt.": "mount", "pt": "port", "pt.": "port"}
BESIDE = r"remote|hybrid|on-?site|hq|headquarters?|office|metro|campus|(?:site|floor|building) \d+|\d+ days? (?:on-?site|remote|in office)"
AROUND = [r"greater (.+?) (?:metro )?area", r"greater (.+)", r"(?:city|town|metro) of (.+)", r"(.+?) (?:metro(?: area)?|office|area|region|hq|site \d+|campus)"]

_BREAKS = re.compile(r"\s*[,;()\[\]|/]\s*|\s+[-–—]\s+|\s*:\s+")
_QUOTES = "\"'“”„«»‹›‘’"


def folded(text: str) -> str:
    """Lower case without marks and doubled blanks; words in short form are written out."""
    plain = unicodedata.normalize("NFD", text.lower())
    plain = "".join(UNDECOMPOSED.get(x, x) for x in plain if not unicodedata.combining(x))
    return " ".join(SHORT_FORMS.get(w, w) for w in plain.split())


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    lb = len(b)
    columns = range(1, lb + 1)
    far = len(a) + lb
    last: dict[str, int] = {}
    shared = set(a) & set(b)
    rows = [[far] * (lb + 2), [far, *range(lb + 1)]]
    for i, x in enumerate(a, 1):
        above = rows[i]
        own = [far, i]
        cost, match = i, 0
        for j in columns:
            y = b[j - 1]
            diagonal, up = above[j], above[j + 1]
            best = diagonal if x == y else 1 + (diagonal if diagonal < up else up)
            if best > cost + 1:
                best = cost + 1
            if match and y in shared:
                k = last.get(y, 0)
                if k:
                    swap = rows[k][match] + i - k + j - match - 1
                    if swap < best:
                        best = swap
            if x == y:
                match = j
            cost = best
            own.append(best)
        rows.append(own)
        last[x] = i
    return cost


@dataclass
class Tree:
    """A BK-tree of names of one length, whose leaves are buckets of up to ``BUCKET`` names.

    A node is a name with its children by distance, or a bucket, which has no name of its own.
    """

    nodes: list[tuple[str | None, dict[int, int], list[str]]] = field(default_factory=list)

    def add(self, name: str) -> None:
        if not self.nodes:
            self.nodes.append((None, {}, []))
        at = 0
        while self.nodes[at][0] is not None:
            word, children, _ = self.nodes[at]
            d = edit_distance(name, word)
            if d == 0:
                return
            at = self._child(children, d)
        bucket = self.nodes[at][2]
        if name in bucket:
            return
        bucket.append(name)
        if len(bucket) > BUCKET:
            self.nodes[at] = (bucket[0], {}, [])
            for other in bucket[1:]:
                self.nodes[self._child(self.nodes[at][1], edit_distance(bucket[0], other))][2].append(other)

    def _child(self, children: dict[int, int], d: int) -> int:
        if d not in children:
            children[d] = len(self.nodes)
            self.nodes.append((None, {}, []))
        return children[d]

    def within(self, name: str, most: int) -> list[tuple[int, str]]:
        """All (distance, name) with a distance of at most ``most``."""
        found, stack, letters = [], [0] if self.nodes else [], set(name)
        while stack:
            word, children, bucket = self.nodes[stack.pop()]
            for other in bucket:  # each letter that only one of two words has takes an edit
                if len(letters.difference(other)) <= most and len(set(other).difference(letters)) <= most:
                    d = edit_distance(name, other)
                    if d <= most:
                        found.append((d, other))
            if word is not None:
                d = edit_distance(name, word)
                if d <= most:
                    found.append((d, word))
                low, high = d - most, d + most
                stack += [child for far, child in children.items() if low <= far <= high]
        return found


def forest(names: list[str]) -> dict[int, Tree]:
    """A tree for each length of names."""
    trees: dict[int, Tree] = {}
    for name in sorted(names):
        trees.setdefault(len(name), Tree()).add(name)
    return trees


def within(trees: Mapping[int, Tree], name: str, most: int) -> list[tuple[int, str]]:
    """All (distance, name) of the trees with a distance of at most ``most``."""
    return [x for n in range(len(name) - most, len(name) + most + 1) if n in trees for x in trees[n].within(name, most)]


def edits_allowed(name: str) -> int:
    return 0 if len(name) < LEAST_LENGTH else 1 if len(name) < SECOND_EDIT else MOST_EDITS


def _bare(value: str) -> str:
    """A value without outer quotes, brackets and closing marks."""
    text = " ".join(value.split())
    while True:
        inner = text.strip(_QUOTES + " .;,/|")
        if len(inner) > 1 and inner[0] == "(" and inner[-1] == ")" and inner.count("(") == inner.count(")") and _closes_last(inner):
            inner = inner[1:-1]
        if inner == text:
            return text
        text = inner


def _leading(text: str) -> re.Match | None:
    """A country's code written before the name."""
    return re.match(r"(\w{2,3})-(?=\S)(.+)$", text)


def _parts(text: str) -> list[str]:
    """What is written between delimiters, without what is only said beside a place."""
    parts = [part.strip(_QUOTES + " .;,") for part in _BREAKS.split(text)]
    return [x for x in parts if x and not re.fullmatch(BESIDE, x.lower())]


def country_candidates(value: str) -> set[str]:
    """The words of a value that would be read as a country if they name one."""
    text = _bare(value)
    lead = _leading(text)
    return {x.lower() for x in _parts(text) + (_parts(lead[2]) + [lead[1]] if lead else [])}


def readings(value: str, countries: Mapping[str, Set[str]]) -> tuple[list[str], Set[str] | None]:
    """The names a typed value may mean, in the order to try, and the countries that the last word for one allows."""
    text = _bare(value)
    names, country = [folded(text)], None
    lead = _leading(text)
    if lead and lead[1].lower() in countries:
        country, text = countries[lead[1].lower()], lead[2]
    parts = []
    for bare in _parts(text):
        if bare.lower() in countries:
            country = countries[bare.lower()]
        else:
            parts.append(bare)
    whole = [", ".join(parts), *parts] if len(parts) > 1 else parts
    for name in whole:
        plain = folded(name).strip(" .")
        names.append(plain)
        for pattern in AROUND:
            match = re.fullmatch(pattern, plain)
            if match:
                names.append(match[1])
    return [x for x in dict.fromkeys(names) if x], country


def _closes_last(text: str) -> bool:
    """Whether the bracket that opens the text is closed by its last character."""
    depth = 0
    for i, x in enumerate(text):
        depth += (x == "(") - (x == ")")
        if depth == 0:
            return i == len(text) - 1
    return False


def map_to_list(values: DataFrame, column: str, entries: DataFrame, countries: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``column, entry_id, edits``: each distinct value with the entry it means; 0 and null if none.

    ``entries`` has ``name, entry_id, country, population``, a row for each name of an entry;
    ``countries`` has ``word, country``, the codes of the countries that a word names, in any letter
    case. Both may have any size. A value's quotes, brackets, closing marks and what is said beside
    the place are set aside, the rest is compared with case, marks and short forms folded.

    Entries of the countries that the last country word of a value names are the only ones that
    count. The first reading that is a listed name decides, without edits; if none is, the reading
    with the fewest edits. Of equals the entry with the most people counts, then the smallest id.
    Null and blank values, and those with no entry within the allowed edits, are unmatched. Null
    names, ids and words are skipped. Without entries nothing matches.
    """
    # values are few bytes and much work, so their partitions go by cores, not by size; by the hash, lest
    # the exchange be taken for the one that distinct has
    tasks = 2 * values.sparkSession.sparkContext.defaultParallelism
    distinct = values.select(F.col(column).cast("string").alias("_value")).distinct().repartition(tasks, F.xxhash64("_value"))
    read = cut_lineage(_read(distinct, countries))
    listed = _folded(entries.where("name is not null and entry_id is not null"))
    fits = F.col("_countries").isNull() | F.array_contains("_countries", F.col("country"))
    worth = [(-F.coalesce("population", F.lit(0))).alias("p"), F.col("entry_id").alias("i")]
    same = read.join(listed, F.col("_name") == F.col("_listed")).where(fits).groupBy("_value").agg(F.min(F.struct("_rank", *worth)).alias("_best"))
    exact = cut_lineage(same.select("_value", F.col("_best.i").alias("entry_id"), F.lit(0).alias("edits")))
    rest = read.join(exact, "_value", "left_anti")
    asked = rest.select("_name").distinct().where(F.length("_name") >= LEAST_LENGTH).repartition(tasks, F.xxhash64("_name"))
    near = rest.join(_near_names(asked, listed, most_names), "_name").join(listed, "_listed").where(fits)
    nearest = near.groupBy("_value").agg(F.min(F.struct("edits", *worth)).alias("_best")).select("_value", F.col("_best.i").alias("entry_id"), F.col("_best.edits").alias("edits"))
    found = exact.unionByName(nearest).withColumnRenamed("_value", "_found")
    best = distinct.join(found, F.col("_value") == F.col("_found"), "left")
    return best.select(F.col("_value").alias(column), F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"), "edits")


def _read(distinct: DataFrame, countries: DataFrame) -> DataFrame:
    """``_value, _rank, _name, _countries``: the readings of each value, and the countries it allows (null for any)."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(v, w) for v in frame["_value"] for w in country_candidates(v)], columns=["_value", "_word"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for value, named in zip(frame["_value"], frame["_named"], strict=True):
                known: dict[str, set[str]] = {}
                for pair in named if named is not None else ():
                    known.setdefault(pair["_word"], set()).add(pair["country"])
                names, allowed = readings(value, known)
                rows += [(value, rank, name, None if allowed is None else sorted(allowed)) for rank, name in enumerate(names)]
            yield pd.DataFrame(rows, columns=["_value", "_rank", "_name", "_countries"])

    given = distinct.where("_value is not null")
    codes = countries.select(F.lower("word").alias("_word"), "country").where("_word is not null and country is not null").distinct()
    named = given.mapInPandas(words, "_value string, _word string").join(codes, "_word").groupBy(F.col("_value").alias("_of")).agg(F.collect_set(F.struct("_word", "country")).alias("_named"))
    both = given.join(named, F.col("_value") == F.col("_of"), "left").select("_value", "_named")
    return both.mapInPandas(read, "_value string, _rank int, _name string, _countries array<string>")


def _folded(entries: DataFrame) -> DataFrame:
    """``_listed, entry_id, country, population`` with the folded name of each entry."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["_listed"] = [folded(x) for x in frame["_listed"]]
            yield frame

    narrow = entries.select(F.col("name").alias("_listed"), F.col("entry_id").cast("long"), F.col("country").cast("string"), F.col("population").cast("double"))
    return cut_lineage(narrow.mapInPandas(fold, "_listed string, entry_id long, country string, population double").distinct())


_MATCHES = "_name string, _listed string, edits int"


def _matches(trees: Mapping[int, Tree], names: pd.Series) -> pd.DataFrame:
    rows = [(name, listed, d) for name in names for d, listed in within(trees, name, edits_allowed(name))]
    return pd.DataFrame(rows, columns=["_name", "_listed", "edits"])


def _near_names(asked: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """``_name, _listed, edits``: the listed names within the allowed edits of each name."""
    names = listed.select("_listed").distinct()
    if rows_within(names, most):
        trees = asked.sparkSession.sparkContext.broadcast(forest([r[0] for r in names.collect()]))

        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield _matches(trees.value, frame["_name"])

        return asked.mapInPandas(find, _MATCHES)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_size": frame["_size"].iloc[:1], "_shard": frame["_shard"].iloc[:1], "_tree": [pickle.dumps(forest(frame["_listed"].tolist()))]})

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _matches(pickle.loads(right["_tree"].iloc[0]), left["_name"]) if len(right) else _matches({}, left["_name"])

    def by_length(df: DataFrame, length: str, size: int, name: str) -> DataFrame:
        """The number of parts of at most about ``size`` of the rows of each length."""
        return df.groupBy(length).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    def part(name: str, parts: str):
        return F.pmod(F.xxhash64(name), F.col(parts)).cast("int")

    one = names.withColumn("_size", F.length("_listed"))
    shards = by_length(one, "_size", most, "_shards")
    trees = cut_lineage(one.join(shards, "_size").withColumn("_shard", part("_listed", "_shards")).groupBy("_size", "_shard").applyInPandas(grow, "_size int, _shard int, _tree binary"))
    edits = F.when(F.length("_name") < SECOND_EDIT, 1).otherwise(MOST_EDITS)  # as edits_allowed has it
    sizes = F.explode(F.sequence(F.length("_name") - edits, F.length("_name") + edits))
    sized = asked.select("_name", sizes.alias("_size")).join(shards, "_size")
    parts = by_length(sized, "_size", MOST_ASKED, "_parts")
    sent = sized.join(parts, "_size").withColumn("_part", part("_name", "_parts")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    held = trees.join(parts, "_size").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    keys = ["_size", "_shard", "_part"]
    return sent.select(*keys, "_name").groupBy(*keys).cogroup(held.select(*keys, "_tree").groupBy(*keys)).applyInPandas(look, _MATCHES)
