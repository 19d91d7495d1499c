"""Rows at given positions of an order, found without sorting.

The order's columns become numbers that compare alike. Counts per leading digit say in which digit a
position lies, counts per next digit inside it, and so on, so a few aggregations, each of a bounded
number of groups, find the exact row; a filter then cuts the table there. Nothing is sorted, shuffled
by row or rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit; a level of the search has so many groups for each position.
DIGIT = 12
_SIGN = -(1 << 63)
_ALL = (1 << 64) - 1


def as_number(c: Column, kind: str) -> Column | None:
    """The column as a long that orders alike (NULL as the least), or None for kinds that have none."""
    if kind in ("tinyint", "smallint", "int", "bigint", "date", "boolean"):
        n = F.unix_date(c).cast("long") if kind == "date" else c.cast("long")
    elif kind in ("timestamp", "timestamp_ntz"):
        n = F.unix_micros(c.cast("timestamp"))
    else:
        return None
    return F.coalesce(n, F.lit(_SIGN).cast("long"))


def _signed(u: int) -> int:
    return u - (1 << 63)


def _find(df: DataFrame, columns: Sequence[str], wanted: list[int]) -> list[tuple]:
    """For each position (from 0) the values of ``columns`` in its row; all columns are longs. The last
    column is the least long where no earlier row ties with this one in the others."""
    found: list[list[int]] = [[] for _ in wanted]
    rest = list(wanted)
    for c in columns:
        if c == columns[-1] and not any(rest):
            return [(*f, _SIGN) for f in found]
        first = list(rest)  # rows that tie so far and stand before
        u = F.col(c).bitwiseXOR(F.lit(_SIGN).cast("long"))  # unsigned bits that order like the number
        prefix, shift = [0] * len(wanted), 64
        while shift > 0:
            step = min(DIGIT, shift)
            shift -= step
            # one aggregation for all positions: rows that share the leading digits of one of them
            cells = {}
            for k in range(len(wanted)):
                cells.setdefault((tuple(found[k]), prefix[k]), []).append(k)
            here = None
            for i, (lead, p) in enumerate(cells):
                cond = F.lit(True)
                for name, value in zip(columns, lead):
                    cond = cond & (F.col(name) == F.lit(value).cast("long"))
                if shift + step < 64:
                    cond = cond & (F.shiftrightunsigned(u, shift + step) == F.lit(p).cast("long"))
                here = F.when(cond, F.lit(i)) if here is None else here.when(cond, F.lit(i))
            digit = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
            counts: dict[int, list] = {}
            for r in df.select(here.alias("cell"), digit.alias("digit")).filter("cell IS NOT NULL").groupBy("cell", "digit").count().collect():
                counts.setdefault(r["cell"], []).append((r["digit"], r["count"]))
            for i, ks in enumerate(cells.values()):
                for k in ks:
                    for d, n in sorted(counts.get(i, [])):
                        if rest[k] < n:
                            prefix[k] = prefix[k] << step | d
                            break
                        rest[k] -= n
        for k in range(len(wanted)):
            found[k].append(_signed(prefix[k] & _ALL) if c != columns[-1] or first[k] else _SIGN)
    return [tuple(f) for f in found]


def cut_at(df: DataFrame, order: Sequence[Column], wanted: Sequence[int], names: Sequence, out: str) -> DataFrame:
    """``df`` plus ``out``: names[i] for the rows before position wanted[i] (and not before an earlier
    one), the last name for the rest. ``order``: long columns; rows that tie in all of them go by the
    order in which ``df`` is read, so the sizes are exact (where a cut falls among such rows, ``df``
    should be read in the same order each time, as files are). Positions ascend."""
    n = len(order)
    work = df.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(order)]).withColumn(f"__o{n}", F.monotonically_increasing_id())
    keys = [f"__o{i}" for i in range(n + 1)]
    total = work.count()
    inside = sorted({w for w in wanted if 0 < w < total})
    at = dict(zip(inside, _find(work.select(*keys), keys, inside) if inside else []))
    here = F.struct(*[F.col(k) for k in keys])
    label = None
    for w, name in zip(wanted, names):
        if w <= 0:
            continue
        cond = F.lit(True) if w >= total else here < F.struct(*[F.lit(v).cast("long") for v in at[w]])
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    last = F.lit(names[-1])
    return work.withColumn(out, last if label is None else label.otherwise(last)).drop(*keys)
