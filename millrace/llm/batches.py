"""Batches of texts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that array operations over a batch of texts take at once; a longer text is one alone.
MOST_CHARACTERS = 2_000_000


def by_size(texts: Sequence[str | None], most: int = MOST_CHARACTERS) -> Iterator[slice]:
    """Slices of consecutive texts of at most ``most`` characters together, or of one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


#: Bytes of an Arrow column that are decoded at once; a longer text is decoded alone.
MOST_BYTES = 4_000_000


def decoded(column: pa.Array, most: int = MOST_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a column of texts with where they begin, so that no whole batch becomes Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, column.slice(start, end - start).to_pylist()
        start = end
