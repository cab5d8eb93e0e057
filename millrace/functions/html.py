"""HTML descriptions as marked lines, and measures of their structure."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a line, that make a heading, that make bold; classes of standing texts.
BLOCKS = frozenset("address article aside blockquote dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOLD = frozenset("b strong".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style head title".split())
STANDING = frozenset(["content-intro", "content-pay-transparency", "content-conclusion"])
HEADING_LENGTH = 80


class _Marker(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.lines: list[tuple[str, bool, bool, bool, bool]] = []  # text, item, heading tag, bold, standing
        self.parts: list[tuple[str, bool]] = []

    def _within(self, tags: frozenset[str]) -> bool:
        return any(t in tags for t, _ in self.open)

    def flush(self) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            bold = all(b for t, b in self.parts if t.strip())
            self.lines.append((text, self._within(frozenset(["li"])), self._within(HEADINGS), bold, any(s for _, s in self.open)))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            classes = set((dict(attrs).get("class") or "").split())
            self.open.append((tag, bool(classes & STANDING)))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if not self._within(HIDDEN):
            self.parts.append((data, self._within(BOLD)))


def _parse(html: str) -> list[tuple[str, bool, bool, bool, bool]]:
    marker = _Marker()
    marker.feed(html)
    marker.close()
    marker.flush()
    return marker.lines


def marked_lines(html: str | None) -> str | None:
    """The text of HTML, a line a block: ``- `` in list items, ``# `` on headings, ``> `` before standing texts.

    A heading is a line of at most 80 characters in a heading tag or all bold, outside list items.
    Signs typed at the start of a line that look like a mark go. Null if there is no text.
    """
    lines = []
    for text, item, heading, bold, standing in _parse(html or ""):
        text = text.lstrip("># ") if text[0] in ">#" else text
        if text:
            sign = "- " if item else "# " if len(text) <= HEADING_LENGTH and (heading or bold) else ""
            lines.append(("> " if standing else "") + sign + text)
    return "\n".join(lines) or None


@F.pandas_udf(T.StringType())
def _marked(pages: pd.Series) -> pd.Series:
    return pages.map(marked_lines)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_lines", "n_items", "n_bold")] + [T.StructField("item_share", T.DoubleType())]))
def _structure(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        lines = _parse(page or "")
        size = sum(len(x[0]) for x in lines)
        rows.append((len(lines), sum(x[1] for x in lines), sum(x[3] for x in lines), sum(len(x[0]) for x in lines if x[1]) / size if size else None))
    return pd.DataFrame(rows, columns=["n_lines", "n_items", "n_bold", "item_share"])


def html_to_lines(html: Column) -> Column:
    return _marked(html)


def html_structure(html: Column) -> Column:
    """Lines, list items, all-bold lines and the share of the text in list items."""
    return _structure(html)
