"""Positions and running sums inside groups of any size.

Rows are sorted by range over the whole cluster, so a group that holds a third of all rows lies in
many partitions. Each partition numbers its own part of a group, and a table with a row for each
(partition, group) says where that part begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], part: str | None = None) -> DataFrame:
    """``df`` plus ``idx`` (from 0, by ``order`` inside ``group``), ``total`` (rows of the group) and,
    if named, ``part`` (ascends with ``idx`` inside a group; rows of one part lay together).

    Group columns are not NULL; in ``order`` NULL comes first. Rows tied in ``order`` get positions
    of their own. ``df`` is read twice, so it should be a table, or cheap; its order of reading
    settles ties, which a lost executor does not change.
    """
    group, order = list(group), list(order)
    keys = [*group, *order, "__tie"]
    spread = df.withColumn("__tie", F.monotonically_increasing_id())
    laid = (spread.repartitionByRange(shuffle_partitions(df), *keys).sortWithinPartitions(*keys)
            .drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    laid = written(laid, "numbered", collect=False).withColumn("__part", F.shiftright("__at", 33))
    cell = ["__part", *group]
    ends = laid.groupBy(*cell).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*cell, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("total"))
    return laid.join(starts, cell).select(
        *df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("idx"), "total",
        *([F.col("__part").alias(part)] if part else []))


def running(df: DataFrame, group: Sequence[str], sums: Sequence[str], part: str = "part") -> DataFrame:
    """A table made with ``numbered`` plus, for each column c of ``sums``, ``c_upto``: its sum over
    the rows of the group up to and with this one. Sums run inside each part, beginning with the
    total of the parts before."""
    cell = [*group, part]
    totals = df.groupBy(*cell).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*cell, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums])
    inside = Window.partitionBy(*cell).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"__local_{c}") for c in sums])
    return local.join(starts, cell).select(*df.columns, *[(F.col(f"__before_{c}") + F.col(f"__local_{c}")).alias(f"{c}_upto") for c in sums])
