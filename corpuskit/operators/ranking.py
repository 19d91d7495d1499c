"""Ordering, retention, splits and top-k (W-01 ... W-13).

Top-k uses ``orderBy().limit`` (each task keeps k rows). Per-group newest-N uses a
``row_number`` window whose sort spills; splits and folds are positional or hash-ranked so
sizes are exact and reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import as_number, cut_at
from .ordered import positional_index


def newest(df: DataFrame, ts: str, limit: int, tie: str | None = None, where: Column | None = None) -> DataFrame:
    """W-01: filter -> newest first (NULL time last) -> limit."""
    d = df.filter(where) if where is not None else df
    order = [F.col(ts).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    return d.orderBy(*order).limit(limit)


def newest_per_group(df: DataFrame, keys: Sequence[str], ts: str, n: int, tie: str | None = None,
                     where: Column | None = None) -> DataFrame:
    """W-02 / W-04: newest ``n`` rows per group (``row_number`` over ts desc, ``<= n``).

    Catalyst's window-group-limit rule adds a partial per-group top-n before the shuffle, so
    a hot group moves at most n rows per input partition.
    """
    d = df.filter(where) if where is not None else df
    order = [F.col(ts).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def retain_newest(df: DataFrame, id_col: str, ts: str, keep: int) -> DataFrame:
    """W-03: keep only the newest ``keep`` rows overall (top-N ids + left semi join)."""
    top = newest(df.select(id_col, ts), ts, keep, tie=id_col).select(id_col)
    return df.join(top, id_col, "left_semi")


def positional_split(df: DataFrame, order: Sequence[str] | str, ratio: float = 0.9) -> DataFrame:
    """W-09: first ``int(n * ratio)`` rows in input order -> train, rest -> validation. Over numbers,
    dates and times the cut is found by counting (``cuts``); other columns are sorted by range."""
    columns = [order] if isinstance(order, str) else list(order)
    kinds = dict(df.dtypes)
    numbers = [as_number(F.col(c), kinds[c]) for c in columns]
    if all(x is not None for x in numbers):
        return cut_at(df, numbers, [int(df.count() * ratio)], ["train", "validation"], "split")
    d = positional_index(df, order, "_pos")  # materialised once; counting it is cheap
    cut = int(d.count() * ratio)
    return d.withColumn("split", F.when(F.col("_pos") < cut, F.lit("train")).otherwise(F.lit("validation"))).drop("_pos")


def hash_order(seed: int, *cols) -> Column:
    """Reproducible shuffle key."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])


def random_split(df: DataFrame, key: str, fractions: Sequence[float] = (0.8, 0.1, 0.1),
                 names: Sequence[str] = ("train", "validation", "test"), seed: int = 42,
                 rounding: str = "floor") -> DataFrame:
    """W-10: seeded shuffle + exact-size split. Rows are ranked by a hash of (seed, key).

    ``rounding="floor"`` (recipe form): the first ``int(n * f1)`` rows go to the first split, up
    to ``int(n * (f1 + f2))`` to the second, and so on; the last split takes the rest.
    ``rounding="ceil_last"`` (trainer form, two splits): the last split gets ``ceil(n * f_last)``
    rows and the first the rest.
    """
    import math
    n = df.count()
    if rounding == "ceil_last":
        if len(fractions) != 2:
            raise ValueError("ceil_last rounding is for two splits")
        wanted = [n - math.ceil(n * fractions[1])]
    else:
        wanted, cum = [], 0.0
        for f in fractions[:-1]:
            cum += f
            wanted.append(int(n * cum))
    return cut_at(df, _shuffled(seed, key), wanted, list(names)[:len(fractions)], "split")


def _shuffled(seed: int, key: str) -> list[Column]:
    """Order of a seeded shuffle: a hash, and another where two rows share it."""
    return [hash_order(seed, key), hash_order(seed + 1, F.lit("tie"), key)]


def approx_split(df: DataFrame, fractions: Sequence[float] = (0.9, 0.1), seed: int = 42):
    """W-10 approximate profile: Spark's Bernoulli ``randomSplit`` (sizes vary)."""
    return df.randomSplit(list(fractions), seed)


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """W-11: k folds as contiguous blocks of the seeded hash order; the first ``n % k`` folds
    hold one row more (the usual shuffled k-fold layout)."""
    q, r = divmod(df.count(), k)
    ends = [(i + 1) * q + min(i + 1, r) for i in range(k - 1)]
    out = cut_at(df, _shuffled(seed, key), ends, list(range(k)), "fold")
    return out.withColumn("fold", F.col("fold").cast("int"))


def first_n(df: DataFrame, order: Sequence[str] | str, n: int) -> DataFrame:
    """W-12: first-N cap in a stated order."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)


def label_ids(df: DataFrame, label: str = "output", seq: str | None = None) -> DataFrame:
    """W-13: distinct labels -> dense id (sorted order, or first-seen order with ``seq``).

    The label table is distinct values, aggregated before the (single-partition) ranking.
    """
    if seq:
        d = df.groupBy(label).agg(F.min(seq).alias("_first"))
        order = ["_first", label]
    else:
        d = df.select(label).distinct()
        order = [label]
    # distributed dense numbering (no single-partition window, whatever the label count)
    return positional_index(d, order, "_pos").select(label, F.col("_pos").cast("int").alias("label_id"))


def job_states(events: DataFrame, job: str = "job_id", ts: str = "ts", seq: str = "seq",
               progress: str = "progress", failed: str = "failed") -> DataFrame:
    """W-08: job state from progress / failure events, as one ordered aggregate per job.

    Progress is clamped to [0, 100]. Completion (progress >= 100) and failure set the status;
    the later of them wins. Without either, a job with any progress > 0 is running, else
    pending. ``started_at``: first progress > 0 at or before the first terminal event
    (strictly before it when that event is a failure). ``completed_at``: last completion.
    """
    p = F.least(F.greatest(F.col(progress), F.lit(0.0)), F.lit(100.0))
    d = events.withColumn("_p", F.when(F.col(failed), F.lit(None)).otherwise(p))
    d = d.withColumn("_kind", F.when(F.col(failed), F.lit("failed")).when(F.col("_p") >= 100, F.lit("completed")))
    o = F.struct(F.col(ts), F.col(seq))
    firsts = d.groupBy(job).agg(
        F.min_by(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), F.col("_kind").alias("k")),
                 F.when(F.col("_kind").isNotNull(), o)).alias("_ft"))
    d = d.join(firsts, job)
    before = F.when(F.col("_ft").isNull() | F.col("_ft.t").isNull(), F.lit(True)).when(
        F.col("_ft.k") == "failed", o < F.struct(F.col("_ft.t"), F.col("_ft.s"))).otherwise(
        o <= F.struct(F.col("_ft.t"), F.col("_ft.s")))
    a = d.groupBy(job).agg(
        F.max_by("_p", F.when(F.col("_p").isNotNull(), o)).alias("progress"),
        F.max_by("_kind", F.when(F.col("_kind").isNotNull(), o)).alias("_last_terminal"),
        F.max(F.col("_p") > 0).alias("_any_started"),
        F.min(F.when((F.col("_p") > 0) & before, F.col(ts))).alias("started_at"),
        F.max(F.when(F.col("_kind") == "completed", F.col(ts))).alias("completed_at"),
        F.max(F.when(F.col("_kind") == "failed", F.col(ts))).alias("failed_at"))
    status = F.coalesce(F.col("_last_terminal"),
                        F.when(F.coalesce(F.col("_any_started"), F.lit(False)), F.lit("running")), F.lit("pending"))
    return a.withColumn("status", status).drop("_last_terminal", "_any_started")
