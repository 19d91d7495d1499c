"""Arrow-batched Python kernels for the few rules built-in functions cannot express.

Each kernel is a vectorised ``pandas_udf`` over a column batch; Spark partitions the rows
and moves them through Arrow. None is a row-at-a-time UDF.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Results are handed on after this many characters of texts, or this many texts.
PIECE_CHARS, PIECE_TEXTS = 1 << 19, 512


def in_pieces(batches: Iterator[pd.Series], result) -> Iterator[pd.Series]:
    """``result`` of every text, in pieces bounded by characters and texts: however many rows an Arrow
    batch has, a worker holds the results of one piece."""
    for texts in batches:
        piece, chars = [], 0
        for text in texts:
            piece.append(result(text))
            chars += len(text or "")
            if chars >= PIECE_CHARS or len(piece) >= PIECE_TEXTS:
                yield pd.Series(piece, dtype=object)
                piece, chars = [], 0
        if piece:
            yield pd.Series(piece, dtype=object)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token lists.

    Bit-parallel form: one machine-word-parallel step per token of ``a`` over a bit mask as
    wide as ``b`` (Python ints), O(len(a) * len(b) / 64) instead of a cell-by-cell table.
    """
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """M-05 kernel (UD-03 row kernel): LCS length of two token arrays, per row of the batch."""
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.DoubleType())
def normal_cdf_udf(z: pd.Series) -> pd.Series:
    """X-09 normal CDF, 0.5 * (1 + erf(z / sqrt 2)); Spark has no ``erf``."""
    import math
    return z.map(lambda v: float("nan") if v is None or v != v else 0.5 * (1.0 + math.erf(v / math.sqrt(2.0))))


def gram_matches(predictions, references, n: int) -> tuple[int, int, int]:
    """n-grams that token lists of predictions and of references share (each as often as both have
    it), of the predictions, of the references."""
    p, r = (Counter(g for t in texts for g in zip(*(t[i:] for i in range(n)))) for texts in (predictions, references))
    small, large = (p, r) if len(p) <= len(r) else (r, p)
    return sum(min(c, large[g]) for g, c in small.items() if g in large), sum(p.values()), sum(r.values())


#: Rows whose results are held at once.
GRAM_ROWS = 256


def gram_matches_udf(orders):
    """M-03 / M-04 kernel: (predictions, references), arrays of token arrays, -> (n, m, pc, rc) for each order."""
    orders = list(orders)

    @F.pandas_udf("array<struct<n:int,m:bigint,pc:bigint,rc:bigint>>")
    def counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ps, rs in batches:
            for at in range(0, len(ps), GRAM_ROWS):
                yield pd.Series([[dict(zip(("n", "m", "pc", "rc"), (n, *gram_matches(p, r, n)))) for n in orders] for p, r in (
                    ([list(t) for t in p], [list(t) for t in r]) for p, r in zip(ps[at:at + GRAM_ROWS], rs[at:at + GRAM_ROWS]))])

    return counts
