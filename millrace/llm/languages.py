"""Languages of documents and of the stretches of mixed ones.

A line's script leaves a few candidate languages; per-word log likelihoods of those add up to a
score a line; Viterbi over the lines with a penalty for each switch gives the path, and its runs
are the segments. The word model is naive Bayes, trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import by_size, decoded

# ISO 639-1 codes with the English names of their languages, in natural order.
LANGUAGE_NAMES = {
    "ar": "arabic", "bg": "bulgarian", "bn": "bengali", "ca": "catalan", "cs": "czech", "da": "danish", "de": "german", "el": "greek",
    "en": "english", "es": "spanish", "et": "estonian", "fa": "persian", "fi": "finnish", "fr": "french", "he": "hebrew", "hi": "hindi",
    "hr": "croatian", "hu": "hungarian", "id": "indonesian", "it": "italian", "ja": "japanese", "ko": "korean", "lt": "lithuanian",
    "lv": "latvian", "ms": "malay", "nl": "dutch", "no": "norwegian", "pl": "polish", "pt": "portuguese", "ro": "romanian",
    "ru": "russian", "sk": "slovak", "sl": "slovenian", "sr": "serbian", "sv": "swedish", "ta": "tamil", "th": "thai", "tr": "turkish",
    "uk": "ukrainian", "ur": "urdu", "vi": "vietnamese", "zh": "chinese",
}
# ISO 639-2 codes of some of them.
LONG_CODES = {"ara": "ar", "chi": "zh", "deu": "de", "dut": "nl", "eng": "en", "fra": "fr", "fre": "fr", "ger": "de", "hin": "hi", "ita": "it", "jpn": "ja", "nld": "nl", "pol": "pl", "por": "pt", "rus": "ru", "spa": "es", "tha": "th", "zho": "zh"}
# Code point ranges of scripts and the languages here that are written in each.
SCRIPTS = {
    "latin": ([(0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)], ["de", "en", "es", "fr", "it", "nl", "pl", "pt", "cs", "da", "fi", "hu", "ro", "sv", "tr", "vi", "id", "ca", "hr", "no", "sk", "sl", "lt", "lv", "et", "ms"]),
    "cyrillic": ([(0x400, 0x530)], ["ru", "uk", "bg", "sr"]),
    "greek": ([(0x370, 0x400)], ["el"]),
    "hebrew": ([(0x590, 0x600)], ["he"]),
    "arabic": ([(0x600, 0x700), (0x750, 0x780)], ["ar", "fa", "ur"]),
    "devanagari": ([(0x900, 0x980)], ["hi"]),
    "bengali": ([(0x980, 0xA00)], ["bn"]),
    "tamil": ([(0xB80, 0xC00)], ["ta"]),
    "thai": ([(0xE00, 0xE80)], ["th"]),
    "hangul": ([(0x1100, 0x1200), (0xAC00, 0xD7B0)], ["ko"]),
    "kana": ([(0x3040, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0)], ["ja"]),
    "han": ([(0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)], ["zh", "ja"]),
}
#: Share of a line's letters from which a script other than Latin decides its candidates.
SCRIPT_SHARE = 0.2
LEAST_LETTERS = 20
SWITCH_PENALTY = 4.0
#: Bounds of the training sample (labelled rows) and of the model (words kept a language).
MOST_TRAINING_ROWS, MOST_WORDS = 20_000, 5_000

_WORDS = re.compile(r"[^\W\d_]+")


def named_language(label: Column) -> Column:
    """The code a label names: a code in any case, with a region or not, or an English name; else null."""
    bare = F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")))
    by_name = F.create_map(*(F.lit(x) for code, name in LANGUAGE_NAMES.items() for x in (name, code)))
    by_long = F.create_map(*(F.lit(x) for pair in LONG_CODES.items() for x in pair))
    stem = F.regexp_extract(bare, "^([a-z]{2,3})(?:[-_][a-z0-9-_]+)?$", 1)
    return F.when(bare.isNull(), None).otherwise(F.coalesce(by_name[bare], F.when(stem.isin(*LANGUAGE_NAMES), stem), by_long[stem]))


def _script_table() -> np.ndarray:
    """The script of each code point of the first planes, 0 for none or one not listed."""
    table = np.zeros(0x32000, np.uint8)
    for k, (ranges, _) in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            table[a:b] = k
    for x in (0xD7, 0xF7):
        table[x] = 0
    return table


def _tokens(words: list[str]) -> list[str]:
    """Words in lower case; in scripts without spaces each character is one."""
    out = []
    for word in words:
        if word[0] >= "⺀" or "฀" <= word[0] < "຀":
            out.extend(word)
        else:
            out.append(word.lower())
    return out


def train_words(labelled: DataFrame, text: str, label: str, seed: int = 1) -> dict[str, dict[str, int]]:
    """Counts of the commonest words of each language over a bounded sample of labelled rows.

    The sample is the rows whose hash is below the share that makes MOST_TRAINING_ROWS of them; of
    each language the MOST_WORDS commonest words are kept. So what reaches the driver is bounded.
    """
    rows = labelled.select(F.col(text).alias("_text"), named_language(F.col(label)).alias("_lang")).where("_lang is not null")
    share = min(1.0, MOST_TRAINING_ROWS / max(1, rows.count()))  # reads the labels only
    pick = F.pmod(F.xxhash64("_text", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        counts: Counter = Counter()
        for frame in frames:
            for body, lang in zip(frame["_text"], frame["_lang"], strict=True):
                counts.update((lang, word) for word in _tokens(_WORDS.findall(body)))
            if len(counts) > 500_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "word", "n"])
                counts.clear()
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "word", "n"])

    words = rows.where("length(_text) > 0").where(pick).mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = words.where("n > 1").withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("_r") <= MOST_WORDS)
    model: dict[str, dict[str, int]] = {}
    for lang, word, n in best.select("lang", "word", "n").collect():
        model.setdefault(lang, {})[word] = n
    return model


class Labeller:
    """Scores lines and finds the segments of documents, a batch at a time."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        present = set(counts) | {x for _, languages in SCRIPTS.values() for x in languages if len(languages) == 1}
        self.languages = sorted(present)
        index = {x: i for i, x in enumerate(self.languages)}
        vocabulary = sorted({w for words in counts.values() for w in words})
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        table = np.zeros((len(vocabulary) + 1, len(self.languages)), np.float32)
        for lang, words in counts.items():
            for w, n in words.items():
                table[self.index[w], index[lang]] = n
        totals = np.maximum(table.sum(0), 1.0)
        chance = (table + 0.05) / (totals + 0.05 * len(vocabulary) + 1)
        # a label is wrong now and then, so no word counts against a language without bound
        mixed = 0.97 * chance + 0.03 * chance.mean(1, keepdims=True)
        score = np.log(mixed)
        self.table = (score - score.max(1, keepdims=True)).astype(np.float32)
        self.table[0] = 0
        self.scripts = _script_table()
        self.allowed = np.zeros((len(SCRIPTS) + 1, len(self.languages)), bool)
        for k, (_, languages) in enumerate(SCRIPTS.values(), 1):
            for x in languages:
                if x in index:
                    self.allowed[k, index[x]] = True
        self.kana, self.han = list(SCRIPTS).index("kana") + 1, list(SCRIPTS).index("han") + 1

    def _lines(self, lines: list[str], words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The candidates and the scores of each line."""
        share = np.zeros((len(lines), len(SCRIPTS) + 1), np.float32)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(lines)), lengths)
        known = flat < len(self.scripts)
        script = np.zeros(len(flat), np.uint8)
        script[known] = self.scripts[flat[known]]
        for k in range(1, len(SCRIPTS) + 1):
            share[:, k] = np.bincount(owner[script == k], minlength=len(lines))
        total = np.maximum(share.sum(1), 1)
        best = share.copy()
        best[:, 1] = 0
        east = best[:, self.kana] + best[:, self.han]
        best[:, self.kana] = np.where(best[:, self.kana] > 0, east, 0)
        best[:, self.han] = np.where(best[:, self.kana] > 0, 0, best[:, self.han])
        other = best.argmax(1)
        chosen = np.where(best.max(1) >= SCRIPT_SHARE * total, other, 1)
        allowed = self.allowed[chosen]
        n = np.fromiter(map(len, words), np.int64, len(words))
        get = self.index.get
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), np.int64, int(n.sum()))
        scores = np.zeros((len(lines), len(self.languages)), np.float32)
        has = n > 0
        if has.any():
            scores[has] = np.add.reduceat(self.table[ids], (np.cumsum(n) - n)[has], axis=0)
        return allowed, scores

    def segments(self, texts: list[str | None]) -> list[tuple[int, int, str, float]]:
        """Rows (index of the text, number of the first line, language, confidence)."""
        owner, number, lines, words = [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            for k, line in enumerate(text.split("\n"), 1):
                found = _WORDS.findall(line) if len(line) >= LEAST_LETTERS else []
                if sum(map(len, found)) >= LEAST_LETTERS:
                    owner.append(i)
                    number.append(k)
                    lines.append(line)
                    words.append(_tokens(found))
        if not lines:
            return []
        allowed, scores = self._lines(lines, words)
        scores = np.where(allowed, scores, -1e4)
        peak = scores.max(1, keepdims=True)
        scores -= peak
        owner_at = np.array(owner)
        first = np.append(True, owner_at[1:] != owner_at[:-1])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(lines)))
        # Viterbi, all documents a line at a time; the best predecessor is the same language or the best other
        best = scores.copy()
        came = np.zeros(scores.shape, np.int16)
        every = np.arange(scores.shape[1], dtype=np.int16)
        for step in range(1, int(sizes.max())):
            at = starts[sizes > step] + step
            before = best[at - 1]
            top = before.argmax(1)
            switch = before[np.arange(len(at)), top] - SWITCH_PENALTY
            stay = before >= switch[:, None]
            best[at] += np.where(stay, before, switch[:, None])
            came[at] = np.where(stay, every, top[:, None])
        path = np.zeros(len(lines), np.int64)
        last = starts + sizes - 1
        path[last] = best[last].argmax(1)
        for back in range(int(sizes.max()) - 1, 0, -1):
            at = starts[sizes > back] + back
            path[at - 1] = came[at, path[at]]
        head = first | np.append(True, path[1:] != path[:-1])
        heads = np.flatnonzero(head)
        summed = np.add.reduceat(scores, heads, axis=0).astype(np.float64)
        own = summed[np.arange(len(heads)), path[heads]]
        confidence = 1 / np.exp(np.minimum(summed - own[:, None], 700)).sum(1)
        return [(owner[h], number[h], self.languages[path[h]], round(float(c), 6)) for h, c in zip(heads, confidence, strict=True)]


def language_segments(df: DataFrame, key: str, label: str, text: str, counts: dict[str, dict[str, int]]) -> DataFrame:
    """``key, label, first_line, lang_code, confidence``: the runs of lines of one language in each text.

    Lines are the pieces between line feeds, numbered from 1. Lines of fewer than LEAST_LETTERS
    letters are ignored: they neither start nor end a segment. ``confidence`` is the posterior of
    the language over the segment's words, among the languages its script allows. Null and empty
    texts, and texts of ignored lines only, have no segment. Equal rows of ``df`` give equal rows.
    The model has at most MOST_WORDS words a language, so it is broadcast.
    """
    model = df.sparkSession.sparkContext.broadcast(counts)
    kind = df.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for batch in batches:
            rows = [(start + part.start + i, *rest) for start, texts in decoded(batch.column(2)) for part in by_size(texts) for i, *rest in labeller.segments(texts[part])]
            at, first, lang, sure = zip(*rows, strict=True) if rows else ((), (), (), ())
            owner = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(first, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())],
                names=["_key", "_label", "first_line", "lang_code", "confidence"],
            )

    narrow = df.select(F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"), F.col(text).alias("_text"))
    found = narrow.mapInArrow(find, f"_key {kind}, _label string, first_line int, lang_code string, confidence double")
    return found.withColumnsRenamed({"_key": key, "_label": label})
