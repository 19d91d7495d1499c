"""D-01 chunk boundaries, in an Arrow-batched kernel: a document's cut depends on the one before.

A profile is a list of marks (separator, characters of it that stay in the chunk), best first. All
places of all marks are looked up once per document; every cut is then a binary search for the last
place in the second half of the window. Ids, counts, filters and the explode around it are native.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import in_pieces


@dataclass(frozen=True)
class Profile:
    size: int
    overlap: int
    marks: tuple[tuple[str, int], ...]
    whole: bool = False  #: text stripped first, and one chunk if it fits
    blanks: bool = False  #: empty chunks stay


# Sizes and marks of the profiles.
PROFILES = {
    "index": Profile(512, 50, ((". ", 2), (".\n", 2), ("! ", 2), ("? ", 2), ("\n\n", 2))),
    "knowledge": Profile(500, 50, (("\n\n", 2), (". ", 2), ("! ", 2), ("? ", 2), ("\n", 1)), whole=True),
    "tutorial": Profile(500, 50, (("\n\n", 0), (". ", 1), ("! ", 1), ("? ", 1)), blanks=True),
}


def chunk_text(text: str | None, profile: str = "index", size: int | None = None, overlap: int | None = None) -> list[str]:
    """Overlapping chunks of one text. A window that ends before the text is cut at its best mark
    past half the size, else at the size; the next window begins ``overlap`` before the cut, also
    when only that is left (a tail made of overlap is a chunk)."""
    p = PROFILES[profile]
    size, overlap = size or p.size, p.overlap if overlap is None else overlap
    if overlap >= size // 2:
        raise ValueError("overlap must be below half the chunk size")
    text = (text or "").strip() if p.whole else text or ""
    if not text:
        return []
    if p.whole and len(text) <= size:
        return [text]
    places = [[m.start() for m in re.finditer(f"(?={re.escape(mark)})", text)] for mark, _ in p.marks]

    def cut(start: int) -> int:
        for (mark, kept), at in zip(p.marks, places):
            last = bisect_right(at, start + size - len(mark)) - 1
            if last >= 0 and at[last] > start + size // 2:
                return at[last] + kept
        return start + size

    spans, start = [], 0
    while start < len(text):
        end = cut(start) if start + size < len(text) else start + size
        spans.append((start, end))
        start = end - overlap
    chunks = [text[a:z].strip() for a, z in spans]
    return chunks if p.blanks else [c for c in chunks if c]


def chunk_udf(profile: str = "index", size: int | None = None, overlap: int | None = None):
    """Arrow kernel: text column -> array of chunk strings."""
    chunk_text("x", profile, size, overlap)  # validate parameters on the driver

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return in_pieces(batches, lambda t: chunk_text(t, profile, size, overlap))

    return _chunks
