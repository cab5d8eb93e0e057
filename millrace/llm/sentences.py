"""Sentence units of texts in many languages and scripts.

Line breaks cut a text into flows, unless a sentence runs on over them; within a flow, sentence
marks (and in Thai, blanks) are candidates. Both kinds are classified by maximum-entropy models,
trained on boundaries that are reliable without one: a mark at the end of a paragraph, a mark before
a small letter, a token that is followed by a mark often and ends a paragraph never.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import decoded

#: Bounds of the training sample, in documents and characters, and of one document in it; it is picked by the hash of the text.
MOST_TRAINING_DOCUMENTS, MOST_TRAINING_CHARACTERS, LONGEST_TRAINED = 4_000, 20_000_000, 50_000
#: Surroundings of candidates whose class a model keeps.
MOST_KNOWN = 100_000
#: Line lengths between which a text can be one whose lines were broken at a fixed width.
LEAST_WIDTH, MOST_WIDTH = 60, 80

# Sentence marks, quotation marks and brackets, list marks.
MARKS = ".!?…‥。！？｡।॥؟۔"
FULL = "。｡।॥۔"
STRONG = "!?！？؟"
PAIRED = {"“": "”", "„": "“”", "«": "»", "‘": "’", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
BRACKETS = "(（["
CLOSERS = ")]”»’›」』）\"'"
OPENERS = "\"'“„«‘‹「『（([¿¡—–-"

# Titles and short words of addresses, which never end a sentence. Each counts as one
# seen TITLE_COUNT times before a name, beside what the sample has.
TITLES = "av bd calle dhr dipl dott dr dra hr ing inż lic mevr mgr mlle mme mr mrs ms mx no nr prof sig sig.ra sr sra srta st str ul via vs г д डॉ श्री ул".split()
TITLE_COUNT = 20

_MARKS = re.compile(f"[{re.escape(MARKS)}]+")
_QUOTES = re.compile("[" + re.escape("".join({x for k, v in PAIRED.items() for x in k + v}) + '"') + "]")
_LINE = re.compile(r"[^\n]+")
_HEAD = re.compile(r"[\s\ufeff]*(?:[-*•][\s\ufeff]+)?")
_LISTED = re.compile(r"[\s\ufeff]*[-*•]\s")
_NEXT = re.compile(r"([\s\ufeff]*)([^\w\s]*)(\w*(?:['’]\w+)?)")
_THAI_BLANK = re.compile(r"(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])")
_DOTTED = re.compile(r"\w{1,4}(?:\.\w{1,4})+")
_CAPITALISED = re.compile(r"[^\W\d_]\w*(?:['’]\w+)?")
_ALNUM = re.compile(r"\w")
_WORD = re.compile(r"\S+")
_BLANKS = " \n\t\u00a0\u202f\u3000"
_OUTER = _BLANKS + "\r\x0b\x0c\x85\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u205f\ufeff"

PERIOD, EXCLAIM, STOP, ELLIPSIS = range(4)


def _case(c: str) -> str:
    """l: small letter, u: capital, o: letter without case, d: digit, n: none of them."""
    if c.islower():
        return "l"
    if c.isupper() or c.istitle():
        return "u"
    return "d" if c.isdigit() else "o" if c.isalpha() else "n"


@dataclass(slots=True)
class Candidate:
    at: int
    kind: int
    before: str
    after: str
    case: str
    spaced: bool
    opened: bool
    closed: bool


def quoted(flow: str) -> dict[int, int]:
    """Where each quotation and bracket that has a counterpart closes, and where it opens."""
    closes: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _QUOTES.finditer(flow):
        c, i = m[0], m.start()
        if c == "’" and i + 1 < len(flow) and flow[i + 1].isalpha() and i and flow[i - 1].isalpha():
            continue
        if c == '"':
            level = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
        else:
            level = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRED.get(stack[k][0], "")), -1)
        if level >= 0:
            closes[i] = stack[level][1]
            del stack[level:]
        elif c in PAIRED or c == '"':
            stack.append((c, i))
    return closes


def candidates(flow: str) -> Iterator[Candidate]:
    """The places in a flow where a sentence may end, except its own end."""
    closes = quoted(flow) if _QUOTES.search(flow) else {}
    spans = [(o, c) for c, o in closes.items()]
    n = len(flow)
    if not _MARKS.search(flow):
        return
    others = [x for x in _BLANKS[1:] if x in flow]
    for m in _MARKS.finditer(flow):
        i, j = m.span()
        run = m[0]
        k, closed = j, False
        while k < n:
            if k in closes:
                k, closed = k + 1, True
            elif flow[k] in " \u00a0\u202f" and k + 1 in closes and flow[k + 1] == "»":
                k, closed = k + 2, True
            elif flow[k] in CLOSERS and (not spans or flow[k] in ")]"):
                k += 1
            else:
                break
        if spans and any(o < i and c >= k for o, c in spans):
            continue
        spaces, signs, word = _NEXT.match(flow, k).groups()
        if not word:
            if not _ALNUM.search(flow, k):
                return
            if not spaces and signs:
                continue
        a = flow.rfind(" ", 0, i) + 1
        for blank in others:
            a = max(a, flow.rfind(blank, a, i) + 1)
        before = flow[a:i].lstrip(OPENERS)
        kind = EXCLAIM if any(c in STRONG for c in run) else STOP if any(c in FULL for c in run) else PERIOD if run == "." else ELLIPSIS
        case = _case(word[0]) if word else "n"
        last = before[-1] if before else " "
        if kind in (PERIOD, EXCLAIM) and not spaces and not closed:
            # run together with the next sentence, unless it is a number, a host or an abbreviation
            if not (case == "u" and (word[1:2].islower() or word[1:2] in ("'", "’")) or case == "u" and signs or case == "o" and _case(last) == "o"):
                if not (kind == EXCLAIM and (case == "u" or case == "o" or run[-1] in "！？؟")):
                    continue
            if kind == PERIOD and (len(before) < 2 or not (_case(last) in "lo" or last.isdigit()) or "." in before or "/" in before or "@" in before):
                continue
        if kind == ELLIPSIS and (case != "u" or _case(last) == "o"):
            continue
        if closed and ("o" in (_case(last), case) or run[-1] in FULL + "！？؟"):  # said by someone: scripts without case don't tell what follows
            continue
        if kind == PERIOD and len(before) == 1 and len(word) == 1 and case == "u" and before.isalpha() and flow[k + len(spaces) + 1 : k + len(spaces) + 2] == ".":
            continue  # initials
        yield Candidate(k, kind, before, word, case, bool(spaces), bool(signs) and signs[-1] in OPENERS, closed)


@dataclass
class Lines:
    """Where the flows of a text begin and end, as far as line breaks tell."""

    flows: list[tuple[int, int]]
    breaks: list[tuple[bool, bool, bool, bool]] = field(default_factory=list)


def _break_features(tight: bool, listed: bool, small: bool) -> np.ndarray:
    return np.array([1.0, tight, listed, small, tight and not listed])


def flows_of(text: str, weights: np.ndarray | None, seen: list | None = None) -> list[tuple[int, int]]:
    """Flows of a text; ``seen`` gets (features, wide text, sentence mark before) of each open line break."""
    lines = []
    for m in _LINE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in _OUTER:
            b -= 1
        if _HEAD.match(text, a).end() < b:
            lines.append((a, b, bool(_LISTED.match(text, a)), m.end()))
    if not lines:
        return []
    # the longest line that another one of its paragraph follows; an address can't be broken
    followed = zip(lines, lines[1:])
    width = max((b - a for (a, b, listed, stop), (c, _, marked, _) in followed if c == stop + 1 and not listed and not marked and text.find("://", a, b) < 0), default=0)
    flows = []
    start, end, listed, stop = lines[0]
    for a, b, marked, after in lines[1:]:
        soft = False
        if a == stop + 1 and not marked:
            word = _WORD.search(text, a, b)
            small = text[word.start()].islower()
            last = a - 2
            while text[last] in _OUTER:
                last -= 1
            line_start = text.rfind("\n", 0, last) + 1
            tight = LEAST_WIDTH <= width <= MOST_WIDTH and last + 1 - line_start + 1 + word.end() - word.start() > width
            features = _break_features(tight, listed, small)
            if seen is not None:
                seen.append((features, width > MOST_WIDTH + 20, text[last] in MARKS + CLOSERS))
            soft = tight and not listed or small if weights is None else float(features @ weights) < 0
        if not soft:
            flows.append((start, end))
            start = a
        end, listed, stop = b, marked or listed and soft, after
    flows.append((start, end))
    return flows


@dataclass
class Model:
    """Counts of tokens around marks, and the weights of the two classifiers."""

    before: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    starts: dict[str, tuple[int, int]] = field(default_factory=dict)
    rates: tuple[float, float, float] = (0.25, 0.05, 0.2)
    weights: list[float] = field(default_factory=list)
    breaks: np.ndarray | None = None
    known: dict = field(default_factory=dict, repr=False)

    def features(self, c: Candidate) -> list[float]:
        ends, small, leads = self.rates
        token = _token(c.before)
        n, at_end, low = self.before.get(token) or self.before.get(f"~{token[-3:]}", (0, 0, 0))
        p = _logit((at_end + 6 * ends) / (n + 6)) if c.kind == PERIOD else _logit(ends)
        q = _logit((low + 6 * small) / (n + 6)) if c.kind == PERIOD else _logit(small)
        total, first = self.starts.get(c.after, (0, 0))
        r = _logit((first + 2 * leads) / (total + 2)) if c.case == "u" else _logit(leads)
        digits = token == "9"
        return [
            1.0, c.kind == EXCLAIM, c.kind == STOP, c.kind == ELLIPSIS, c.case == "l", c.case == "u", c.case == "d", c.case == "o", c.opened,
            len(c.before) == 1 and c.before.isalpha(), _DOTTED.fullmatch(c.before) is not None, digits, len(c.before) <= 3 and not digits,
            p, q, r, _case(c.before[-1:] or " ") == "o", c.closed, not c.spaced, r if digits else 0.0, r if n >= 30 and at_end * 50 < n else 0.0,
        ]

    def ends(self, c: Candidate) -> bool:
        """Whether a sentence ends there; what was found of equal surroundings is kept for the next time."""
        key = (c.kind, c.before, c.after, c.case, c.spaced, c.opened, c.closed)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            found = self.known[key] = sum(w * x for w, x in zip(self.weights, self.features(c), strict=True) if x) > 0
        return found


def _token(before: str) -> str:
    """What a token before a mark is counted as: numbers are one type, single letters are another."""
    bare = before.lower()
    if len(bare) == 1 and bare.isalpha():
        return "~letter"
    return "9" if bare.replace(",", "").replace(".", "").isdigit() else bare


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of the maximum-entropy model of two classes, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / total + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / total + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: Iterable[str]) -> Model:
    """A model from the reliable boundaries of a bounded sample of texts."""
    texts = [t for t in texts if t and not t.isspace()]
    model = Model()
    seen: list = []
    for text in texts:
        flows_of(text, None, seen)
    rows = [(f, 1.0) for f, wide, _ in seen if wide] + [(f, 0.0) for f, wide, mark in seen if not wide and not mark and f[3]]
    if rows and 0 < sum(y for _, y in rows) < len(rows):
        x, y = np.array([f for f, _ in rows], float), np.array([y for _, y in rows])
        x[y == 0, 3] = 0  # small letters made the label; the rest has to tell without
        extra = np.array([_break_features(False, False, True)] * max(1, int((y == 0).sum() // 4)))
        x, y = np.vstack([x, extra]), np.append(y, np.zeros(len(extra)))
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        model.breaks = fit_logistic(x, y, share)

    inline: list[Candidate] = []
    final: list[Candidate] = []
    count, at_end, low, capital, first, numbered = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for text in texts:
        flows = flows_of(text, model.breaks)
        for number, (a, b) in enumerate(flows):
            flow = text[_HEAD.match(text, a).end() : b]
            words = _CAPITALISED.findall(flow)
            capital.update(w for w in words if w[0].isupper())
            if words and words[0][0].isupper() and flow[-1] in MARKS + CLOSERS:
                first[words[0]] += 1
            for c in candidates(flow):
                inline.append(c)
                if c.kind == PERIOD:
                    token = _token(c.before)
                    numbered[c.after] += token == "9"
                    for name in (token, f"~{token[-3:]}"):
                        count[name] += 1
                        low[name] += c.case in "ld"
            end = flow.rstrip(CLOSERS + _OUTER)
            stripped = end.rstrip(MARKS)
            run = end[len(stripped) :]
            if not run:
                continue
            before = stripped[max(stripped.rfind(x) for x in _BLANKS) + 1 :].lstrip(OPENERS)
            kind = EXCLAIM if any(x in STRONG for x in run) else STOP if any(x in FULL for x in run) else PERIOD if run == "." else ELLIPSIS
            if kind == PERIOD:
                for name in (_token(before), f"~{_token(before)[-3:]}"):
                    count[name] += 1
                    at_end[name] += 1
            if number + 1 < len(flows):
                spaces, signs, word = _NEXT.match(text, _HEAD.match(text, flows[number + 1][0]).end()).groups()
                if word and not word[0].islower():
                    final.append(Candidate(0, kind, before, word, _case(word[0]), True, bool(signs) and signs[-1] in OPENERS, len(end) < len(flow)))
    total = max(1, sum(count.values()))
    count.update(dict.fromkeys(TITLES, TITLE_COUNT))
    squash = lambda p: min(max(p, 0.02), 0.98)
    model.before = {t: (n, at_end[t], low[t]) for t, n in count.items() if n > 1}
    model.starts = {w: (n, first[w]) for w, n in capital.items() if n > 1}
    model.rates = (squash(sum(at_end.values()) / total), squash(sum(low.values()) / total), squash(sum(first.values()) / max(1, sum(capital.values()))))

    data: list[tuple[Candidate, float]] = [(c, 1.0) for c in final if c.kind != ELLIPSIS]
    for c in inline:
        n, last, small = model.before.get(_token(c.before), (0, 0, 0))
        if c.case == "l":
            data.append((c, 0.0))
        elif c.kind == PERIOD and c.case == "d" and c.before.isalpha() and len(c.before) <= 4 or c.kind == PERIOD and n >= 30 and last == 0:
            data.append((c, 0.0))
        elif c.kind == PERIOD and c.case == "u" and _token(c.before) == "9" and first[c.after] * 50 <= capital[c.after] and numbered[c.after] * 3 >= capital[c.after] > 9:
            data.append((c, 0.0))  # ordinals: a word that follows them often and never starts a sentence
        elif c.kind == PERIOD and c.case == "u" and small * 50 > n and last * 50 > n:  # an abbreviation that also ends sentences
            total, leads = model.starts.get(c.after, (0, 0))
            if total >= 10:
                data.append((c, float(leads * 5 > total)))
        elif c.kind == PERIOD and n >= 8 and last * 12 >= n and small * 50 <= n and c.case in "uo" or c.kind in (EXCLAIM, STOP) and c.case in "uo":
            data.append((c, 1.0))
    if data:
        y = np.array([v for _, v in data])
        x = np.array([model.features(c) for c, _ in data], float)
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        model.weights = fit_logistic(x, y, share).tolist()
    if not data or len(set(y)) < 2:
        model.weights = [0.5, 2, 2, -1, -8, 1, -1, 1, 1, -3, -2, 0, 0, 0.5, -0.5, 0.3, 0, 0, 0, 0.3, 0.3]
    return model


def units_of(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Start and end of each sentence unit of a text, in code points."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    for a, b in flows_of(text, model.breaks):
        start = _HEAD.match(text, a).end()
        flow = text[start:b]
        cuts = [c.at for c in candidates(flow) if model.ends(c)]
        blanks = [m.start() for m in _THAI_BLANK.finditer(flow)]
        if blanks:
            cuts = sorted({*cuts, *blanks})
        at, held = 0, len(out)
        for cut in [*cuts, len(flow)]:
            s, e = at, cut
            while s < e and flow[s] in _OUTER:
                s += 1
            while e > s and flow[e - 1] in _OUTER:
                e -= 1
            at = cut
            if s < e:
                if _ALNUM.search(flow, s, e):
                    out.append((start + s, start + e))
                elif len(out) > held:  # marks alone go with the unit before them
                    out[-1] = (out[-1][0], start + e)
    return out


def train_on(df: DataFrame, text: str) -> Model:
    """A model from a sample within the bounds (about), of whole distinct documents picked by the hash of their text.

    The number of rows, which tells the share to pick, needs no text; so the texts are read once. What
    is collected is bounded by MOST_TRAINING_DOCUMENTS times LONGEST_TRAINED characters, about, and
    cut to MOST_TRAINING_CHARACTERS in order of the hash. Longer documents are no part of it. A text
    that stands in many rows counts once.
    """
    rows = df.select(F.col(text).alias("_text"))
    share = min(1.0, MOST_TRAINING_DOCUMENTS / max(1, rows.count()))
    pick = F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < int(share * (1 << 20))
    some = rows.where(f"length(_text) <= {LONGEST_TRAINED}").where(pick).where("trim(_text) <> ''").distinct()
    texts, size = [], 0
    for _, body in sorted(some.select(F.xxhash64("_text"), "_text").collect()):
        size += len(body)
        if size > MOST_TRAINING_CHARACTERS:
            break
        texts.append(body)
    return train(texts)


def sentence_units(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key, start_at, end_at``: a row a sentence unit; offsets in code points, the end exclusive.

    A unit has no outer white space, list marks or byte order mark and keeps its final marks and
    closing quotes and brackets. Headings and list items are units. In Thai a blank between two Thai
    characters ends a unit. Null, empty and blank texts have none. Texts are read whole, whatever
    their length; equal rows of ``df`` give equal rows. Only the two named columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units_of(body, shared.value) for _, texts in decoded(batch.column(1)) for body in texts]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            ends = np.array([x for units in found for x in units], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["_key", "start_at", "end_at"])

    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInArrow(split, f"_key {kind}, start_at int, end_at int").withColumnRenamed("_key", key)
