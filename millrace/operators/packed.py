"""Several values packed in one field: split into one row a value, with its position.

The split runs on Arrow batches. The flat code points of a batch are classified by array
operations: quote parity and bracket depth are running sums that restart at each string, a
delimiter counts where neither encloses it, and the child offsets are the runs between the
delimiters that count. No Python code runs per row or per value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import rows_within

# Characters that separate values, quote them or are blank.
STRONG = ";|+\n\r\v\f  •‣·、；｜"
SLASHES = "/／"
COMMAS = ",，"
OPENING, CLOSING = "“„«‹「『", "”»›」』"
BLANKS = " \t              　﻿"
JOINING_WORDS = ("and", "or", "&")

#: A run of letters and digits.
_RUN = r"[\p{L}\p{N}]+"

_ENCLOSED = [("\"", "\""), ("'", "'"), ("‘", "’"), ("’", "’"), ("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』")]


def _among(points: np.ndarray, characters: str) -> np.ndarray:
    return np.isin(points, np.fromiter(map(ord, characters), np.uint32))


def _running(marks: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sum that restarts at each string."""
    total = np.cumsum(marks, dtype=np.int64)
    before = np.concatenate([[0], total])[starts]
    return total - before[rows]


def _strings(raw: np.ndarray, byte_at: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The code point ranges [first, end) as an Arrow string array; ranges are in order and apart."""
    a, b = byte_at[first], byte_at[end]
    change = np.zeros(len(raw) + 1, np.int8)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    data = raw[np.cumsum(change[:-1]).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))


def split_strings(texts: pa.Array, suffixes: pa.Array, whole: Iterable[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each value its string's index and its position from 1, and the values themselves."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pa.concat_arrays([texts])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts_of_points = np.flatnonzero((raw & 0xC0) != 0x80)
    byte_at = np.append(starts_of_points, len(raw))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(starts_of_points, offsets)
    starts, ends = bounds[:-1], bounds[1:]
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    rows = np.repeat(np.arange(len(texts)), ends - starts)
    first_of_row, last_of_row = np.zeros(n, bool), np.zeros(n, bool)
    filled = ends > starts
    first_of_row[starts[filled]] = True
    last_of_row[ends[filled] - 1] = True

    distinct, back = np.unique(points, return_inverse=True)
    small = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in map(chr, distinct)], np.uint32)[back]
    lettered = np.array([x.isalnum() for x in map(chr, distinct)], bool)[back]
    blank, comma = _among(points, BLANKS), _among(points, COMMAS)
    strong = _among(points, STRONG)

    # brackets of a list that encloses a whole string count as blank
    shown = np.flatnonzero(~blank)
    if len(shown):
        at_first = np.searchsorted(shown, starts)
        at_last = np.searchsorted(shown, ends) - 1
        has = at_first <= at_last
        a, b = shown[at_first[has]], shown[at_last[has]]
        listed = (points[a] == ord("[")) & (points[b] == ord("]")) & (a < b)
        blank[a[listed]] = True
        blank[b[listed]] = True

    def shifted(mask: np.ndarray, by: int, outside: bool) -> np.ndarray:
        """mask at the previous (by=1) or next (by=-1) character of the same string."""
        moved = np.roll(mask, by)
        moved[first_of_row if by == 1 else last_of_row] = outside
        return moved

    # a slash between two single letters is part of a short form, as in n/a
    before, after = shifted(lettered, 1, False), shifted(lettered, -1, False)
    alone = lettered & ~before & ~after
    strong |= _among(points, SLASHES) & ~(shifted(alone, 1, False) & shifted(alone, -1, False))

    # what encloses: straight quotes by parity, the others by depth
    escaped = shifted(points == ord("\\"), 1, False)
    straight = (points == ord('"')) & ~escaped
    apart = blank | comma | strong | _among(points, "([")
    apart_after = blank | comma | strong | _among(points, ")]")
    single = _among(points, "'‘’")
    opens = single & shifted(apart, 1, True) & ~shifted(blank, -1, True)
    closes = single & ~opens & shifted(apart_after, -1, True)
    inside = np.zeros(n, bool)
    if straight.any():
        odd = np.bincount(rows[straight], minlength=len(texts)) % 2 == 1
        inside |= (_running(straight, rows, starts) % 2 == 1) & ~odd[rows]
    for up, down in ((opens, closes), (_among(points, OPENING), _among(points, CLOSING)), (points == ord("("), points == ord(")"))):
        if up.any():
            level = up.astype(np.int8) - down.astype(np.int8)
            depth = _running(level, rows, starts)
            uneven = np.zeros(len(texts), bool)
            uneven[rows[depth < 0]] = True
            uneven[filled] |= depth[ends[filled] - 1] != 0
            inside |= (depth > 0) & ~uneven[rows]

    # names that hold a delimiter themselves
    flat = small.astype("<u4").tobytes().decode("utf-32-le")
    for name in whole:
        at = flat.find(name)
        while at >= 0:
            end = at + len(name)
            if rows[at] == rows[end - 1] and (first_of_row[at] or not lettered[at - 1]) and (last_of_row[end - 1] or not lettered[end]):
                inside[at:end] = True
            at = flat.find(name, at + 1)

    # words that join the last value
    for word in JOINING_WORDS:
        match = shifted(blank, 1, False)
        for k, x in enumerate(word):
            moved = np.roll(small, -k)
            match = match & (moved == ord(x))
        width = len(word)
        at = np.flatnonzero(match)
        at = at[at + width < n]
        at = at[(rows[at] == rows[at + width]) & blank[at + width]]
        for k in range(width):
            strong[at + k] = True
    strong &= ~inside
    comma &= ~inside
    cut = strong | comma

    # child offsets: between the delimiters of each string
    where = np.flatnonzero(cut)
    first = np.sort(np.concatenate([starts[filled], where + 1]), kind="stable")
    end = np.sort(np.concatenate([ends[filled], where]), kind="stable")
    visible = ~blank & ~cut
    place = np.flatnonzero(visible)
    low, high = np.searchsorted(place, first), np.searchsorted(place, end)
    kept = high > low
    first, end = place[low[kept]], place[high[kept] - 1] + 1
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    row = rows[first]
    # a comma alone between two children of a string leaves open whether they are one value
    hard = np.concatenate([[0], np.cumsum(strong)])
    loose = np.zeros(len(first), bool)
    loose[1:] = (row[1:] == row[:-1]) & (hard[first[1:]] == hard[end[:-1]])
    named = pc.utf8_lower(pc.utf8_trim(_strings(raw, byte_at, first, end), characters=BLANKS + "\"'.()"))
    country = np.asarray(pc.is_in(named, value_set=suffixes))
    run = np.cumsum(~loose) - 1
    leading = country[np.flatnonzero(~loose)][run]
    before = np.roll(country, 1)
    merged = loose & np.where(leading, ~country & before, country)
    head = ~merged
    head_at = np.flatnonzero(head)
    first, end, row = first[head_at], end[np.append(head_at[1:], len(head)) - 1], row[head_at]

    values = _bare(_strings(raw, byte_at, first, end))
    shown_value = np.asarray(pc.greater(pc.utf8_length(values), 0))
    values, row = values.filter(pa.array(shown_value)), row[shown_value]
    counts = np.bincount(row, minlength=len(texts))
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), values)
    parents = pc.list_parent_indices(lists).to_numpy()
    position = np.arange(len(parents)) - (np.cumsum(counts) - counts)[parents] + 1
    return parents, position, pc.list_flatten(lists)


def _bare(values: pa.Array) -> pa.Array:
    """Values without list marks, outer blanks, enclosing quotes and quote escapes."""
    values = pc.utf8_trim(values, characters=BLANKS)
    values = pc.replace_substring_regex(values, r"^(?:[-*–]|\d{1,3}[.)])\s+", "")
    for opening, closing in _ENCLOSED:
        twice = pc.and_(pc.starts_with(values, opening), pc.ends_with(values, closing))
        twice = pc.and_(twice, pc.greater(pc.utf8_length(values), 1))
        content = pc.utf8_slice_codeunits(values, 1, -1)
        if opening == '"':  # quotes that enclose only a part of the value stay
            single = pc.replace_substring(pc.replace_substring(content, '\\"', ""), '""', "")
            twice = pc.and_(twice, pc.invert(pc.match_substring(single, '"')))
            content = pc.replace_substring(content, '""', '"')
        values = pc.if_else(twice, content, values)
    return pc.utf8_trim(pc.replace_substring(values, '\\"', '"'), characters=BLANKS)


def split_packed(df: DataFrame, key: str, packed: str, suffixes: Iterable[str] = (), whole: Iterable[str] = ()) -> DataFrame:
    """One row a value of ``packed``: ``key, pos`` (from 1), ``value, n_values`` (of its row).

    Values are separated by semicolons, bars, plus signs, slashes, line breaks, bullets, commas and a
    joining word or ampersand between blanks, unless they are a slash between two single letters
    (n/a), or quotes (straight, doubled or escaped, single, angled or
    curly), brackets or a name of ``whole`` enclose them. A comma before one of ``suffixes`` (states,
    countries; in any letter case) belongs to the value before it; where such a word leads, to the
    one after it. Quotes and brackets without a counterpart enclose nothing.

    A null, empty or blank field, or one of delimiters only, gives no rows; a field with one value
    gives one. Repeated rows and equal values are kept. Any other column of ``df``, whatever its
    name, is left out. ``suffixes`` and ``whole`` go to the tasks with the code, so they must be
    lists of bounded size; ``split_by_lists`` takes tables of any size.
    """
    endings = pa.array(sorted({x.lower() for x in suffixes}), pa.large_string())
    names = sorted({x.lower() for x in whole})
    kind = df.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _split_batch(batch, endings, names)

    narrow = df.select(F.col(key).alias("_key"), F.col(packed).alias("_packed")).where(F.col("_packed").isNotNull())
    return narrow.mapInArrow(split, f"_key {kind}, pos int, value string, n_values int").withColumnRenamed("_key", key)


def _split_batch(batch: pa.RecordBatch, endings: pa.Array, names: Iterable[str]) -> pa.RecordBatch:
    parents, position, values = split_strings(batch.column(1), endings, names)
    count = np.bincount(parents, minlength=batch.num_rows)[parents]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(parents)), pa.array(position, pa.int32()), values.cast(pa.string()), pa.array(count, pa.int32())],
        names=["_key", "pos", "value", "n_values"],
    )


#: Words of a list that go to the tasks with the code; of longer lists each field gets those it holds, by a join.
MOST_WORDS = 20_000


def holds_delimiter(name: Column) -> Column:
    """Whether a name would be split."""
    words = "|".join(JOINING_WORDS)
    return name.rlike(rf"[\Q{STRONG}{SLASHES}{COMMAS}\E]") | F.lower(name).rlike(rf"\s(?:{words})\s")


def split_by_lists(df: DataFrame, key: str, packed: str, suffixes: DataFrame, whole: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``split_packed`` with its two lists as tables of one column, of any size; the result is the same.

    Words that hold no letter or digit are no suffixes or names. Null words are skipped.
    """
    lists = [x.select(F.lower(F.col(x.columns[0])).alias("_word")).where(F.col("_word").rlike(_RUN)).distinct() for x in (suffixes, whole)]
    if all(rows_within(x, most_words) for x in lists):
        endings, names = ([r[0] for r in x.collect()] for x in lists)
        return split_packed(df, key, packed, endings, names)
    narrow = df.select(F.col(key).alias("_key"), F.col(packed).alias("_packed")).where(F.col("_packed").isNotNull())
    known = lists[0].withColumn("_ends", F.lit(True)).unionByName(lists[1].withColumn("_ends", F.lit(False)))
    runs = lambda x: F.regexp_extract_all(x, F.lit(_RUN), F.lit(0))
    longest = F.array_max(F.transform(runs(F.col("_word")), lambda x: F.struct(F.length(x).alias("n"), x.alias("run"))))["run"]
    fields = narrow.select("_packed").distinct().withColumn("_run", F.explode(F.array_distinct(runs(F.lower("_packed")))))
    held = fields.join(known.withColumn("_run", longest), "_run").where(F.lower("_packed").contains(F.col("_word")))
    own = held.groupBy(F.col("_packed").alias("_field")).agg(
        F.collect_set(F.when(F.col("_ends"), F.col("_word"))).alias("_endings"), F.collect_set(F.when(~F.col("_ends"), F.col("_word"))).alias("_names")
    )
    kind = df.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # what one field holds can't matter to another that doesn't
            endings, names = (pc.unique(pc.list_flatten(batch.column(k))) for k in (2, 3))
            yield _split_batch(batch, endings.cast(pa.large_string()), names.to_pylist())

    joined = narrow.join(own, F.col("_packed") == F.col("_field"), "left").select("_key", "_packed", "_endings", "_names")
    return joined.mapInArrow(split, f"_key {kind}, pos int, value string, n_values int").withColumnRenamed("_key", key)
