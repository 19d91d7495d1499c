"""Order-aware building blocks that stay safe under hot keys.

* ``keep_first``: first row per key by an explicit sequence, as a ``min_by`` aggregate.
  It is partially aggregated on the map side, so a key holding a third of all rows is
  reduced to one candidate per map task before the shuffle (a ``row_number`` window would
  sort that whole key inside one task).
* ``lead_split``: the next row per key in order. The window runs per (key, bucket of the
  order column) so a hot key is spread over many tasks; each bucket's last row gets its
  successor from a small per-bucket table.
* ``ordered_concat``: ordered string aggregation, built in two phases (per key and order
  bucket, then per key over the bucket strings).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def keep_first(df: DataFrame, key: Column | str | Sequence, order: Sequence[str] | str,
               with_key: bool = False) -> DataFrame:
    """J-01 core: keep the row with the smallest ``order`` per ``key`` (first-wins, exact).

    ``key`` may be column names or one expression (e.g. ``lower(trim(input))``).
    """
    cols = df.columns
    keys = _cols(key)
    key_exprs = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = [e.alias(f"_k{i}") for i, e in enumerate(key_exprs)]
    order_struct = F.struct(*[F.col(o) for o in _cols(order)])
    out = (df.select(*named, F.struct(*[F.col(c) for c in cols]).alias("_row"), order_struct.alias("_ord"))
           .groupBy(*[f"_k{i}" for i in range(len(named))])
           .agg(F.min_by("_row", "_ord").alias("_row")))
    sel = [F.col(f"_row.{c}").alias(c) for c in cols]
    if with_key:
        sel += [F.col(f"_k{i}") for i in range(len(named))]
    return out.select(*sel)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name where NULL equals NULL; the right side's keys are dropped."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(named, cond, how).drop(*[f"_on_{c}" for c in on])


def lead_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str],
               bucket: Column, prefix: str = "next_") -> DataFrame:
    """Add ``next_<c>`` for every ``c`` in ``order + carry``: the next row per key in order.

    ``bucket`` must be non-decreasing in ``order`` within a key (e.g. ``floor(turn/1024)``).
    """
    keys, order, carry = list(keys), list(order), list(carry)
    fields = order + [c for c in carry if c not in order]
    d = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    payload = F.struct(*[F.col(c) for c in fields])
    d = d.withColumn("_nx", F.lead(payload).over(w))
    firsts = (d.groupBy(*keys, "_b")
              .agg(F.min_by(payload, F.struct(*[F.col(c) for c in order])).alias("_first")))
    wb = Window.partitionBy(*keys).orderBy("_b")
    nxt = firsts.select(*keys, "_b", F.lead("_first").over(wb).alias("_nb"))
    d = null_safe_join(d, nxt, keys + ["_b"], "left")
    d = d.withColumn("_nx", F.coalesce("_nx", "_nb"))
    return d.select(*df.columns, *[F.col(f"_nx.{c}").alias(prefix + c) for c in fields])


def ordered_concat(df: DataFrame, keys: Sequence[str], order: str, value: str, sep: str,
                   out: str = "text", bucket: Column | None = None) -> DataFrame:
    """Ordered ``array_agg`` + ``array_join`` of ``value`` per key.

    With ``bucket`` (non-decreasing in ``order``) the join runs in two phases so a hot key's
    elements are concatenated in many tasks first.
    """
    keys = list(keys)
    if bucket is not None:
        part = (df.withColumn("_b", bucket)
                .groupBy(*keys, "_b")
                .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_l"))
                .select(*keys, F.col("_b").alias("o"), F.array_join(F.transform("_l", lambda x: x["v"]), sep).alias("v"),
                        F.size("_l").alias("_n")))
        df, order, value, count = part, "o", "v", F.sum("_n")
    else:
        count = F.count(F.lit(1))
    agg = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return (df.groupBy(*keys).agg(agg.alias("_l"), count.alias("n_parts"))
            .select(*keys, F.array_join(F.transform("_l", lambda x: x["v"]), sep).alias(out), "n_parts"))


def positional_index(df: DataFrame, order: Sequence[str] | str, out: str = "pos") -> DataFrame:
    """0-based global position of each row in ``order`` (which should be a total order).

    Distributed: range-sort, number rows inside each partition, materialise once to the
    shared checkpoint folder (so partition numbering cannot change on recompute or executor
    loss), then add each partition's offset from a table with one row per partition.
    """
    from ..session import cut_lineage
    order = _cols(order)
    s = (df.orderBy(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    s = s.withColumn("_rn", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_rn"))
            .drop("_pid", "_mid", "_rn", "_off"))


def running_sum_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                      bucket: Column, out: str = "running", how: str = "sum") -> DataFrame:
    """Running ``sum`` (or ``max``) of ``value`` per key in ``order`` (unbounded preceding ..
    current row).

    Computed per (key, bucket) plus the combined totals of earlier buckets of the key, which
    come from a small per-bucket table; a hot key is therefore spread over many tasks.
    """
    keys, order = list(keys), list(order)
    agg = F.sum if how == "sum" else F.max
    d = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", agg(value).over(w))
    tot = d.groupBy(*keys, "_b").agg(agg(value).alias("_t"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0) if how == "sum" else F.lit(None)
    off = tot.select(*keys, "_b", F.coalesce(agg("_t").over(wb), zero).alias("_off"))
    comb = (F.col("_off") + F.col("_local")) if how == "sum" else F.greatest("_off", "_local")
    return null_safe_join(d, off, [*keys, "_b"]).withColumn(out, comb).drop("_b", "_local", "_off")
