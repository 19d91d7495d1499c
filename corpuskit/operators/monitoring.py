"""Metric-point analytics (A-14 ... A-17, W-07): counters, gauges, histograms, quantiles.

Points: ``name, labels MAP<STRING,STRING>, value DOUBLE, ts TIMESTAMP`` (+ optional seq).
A label set is keyed by its sorted entries so equal maps group together whatever their
insertion order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default histogram upper bounds (the usual latency bounds, seconds).
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def label_key(labels: str = "labels"):
    return F.array_sort(F.map_entries(F.col(labels)))


def counter_total(points: DataFrame, name: str, match: dict | None = None) -> DataFrame:
    """A-14: sum of a counter over points whose labels include every ``match`` pair."""
    cond = F.col("name") == name
    for k, v in (match or {}).items():
        cond = cond & (F.try_element_at(F.col("labels"), F.lit(k)) == F.lit(v))
    return points.filter(cond).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def counter_rollup(points: DataFrame) -> DataFrame:
    """A-14 export form: total per (name, full label set)."""
    return points.groupBy("name", label_key().alias("label_set")).agg(F.sum("value").alias("total"))


def gauge_last(points: DataFrame, seq: str | None = None) -> DataFrame:
    """A-15: last value per (name, label set) by (ts, seq)."""
    order = F.struct("ts", F.col(seq)) if seq else F.struct("ts")
    return points.groupBy("name", label_key().alias("label_set")).agg(F.max_by("value", order).alias("value"))


def histogram(points: DataFrame, bounds: Sequence[float] = DEFAULT_BOUNDS, group: Sequence = ()) -> DataFrame:
    """A-16: cumulative bucket counts (``value <= le``) with +Inf, sum and count per group.

    One pass: ``count_if`` per bound inside a single aggregation (bounds are parameters,
    not data), then one row per (group, le). Standard cumulative buckets, counted once (D2).
    """
    group = list(group)
    aggs = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    a = points.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"))
    les = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(bounds)]
    les.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cum")))
    return a.select(*group, "count", "sum", F.explode(F.array(*les)).alias("x")).select(*group, "x.le", "x.cum", "count", "sum")


def bucket_quantile(buckets: DataFrame, q: float, group: Sequence = ()) -> DataFrame:
    """A-17: quantile from cumulative buckets with linear interpolation inside the bucket
    holding rank ``q * count`` (lower edge 0 for the first bucket). If that bucket is +Inf the
    highest finite bound is returned; no observations -> NULL.

    Works on the bucket table (rows = groups x bounds), never on raw points.
    """
    group = list(group)
    w = Window.partitionBy(*group).orderBy("le")
    b = buckets.withColumn("prev_le", F.lag("le").over(w)).withColumn("prev_cum", F.lag("cum").over(w))
    b = b.withColumn("rank", F.lit(q) * F.col("count"))
    hit = b.filter((F.col("cum") >= F.col("rank")) & (F.col("count") > 0))
    first = hit.groupBy(*group).agg(F.min_by(F.struct("le", "prev_le", "cum", "prev_cum", "rank"), "le").alias("h"))
    lo = F.coalesce(F.col("h.prev_le"), F.lit(0.0))
    pc = F.coalesce(F.col("h.prev_cum"), F.lit(0))
    inb = F.col("h.cum") - pc
    est = F.when(F.col("h.le") == float("inf"), F.col("h.prev_le")) \
        .when(inb > 0, lo + (F.col("h.le") - lo) * (F.col("h.rank") - pc) / inb).otherwise(F.col("h.le"))
    return first.select(*group, F.lit(q).alias("q"), est.alias("value"))


def in_flight(events: DataFrame, key: Sequence[str], ts: str, delta: str, seq: str) -> DataFrame:
    """W-07: running sum of +1/-1 events per key in (ts, seq) order."""
    w = Window.partitionBy(*key).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("in_flight", F.sum(delta).over(w))
