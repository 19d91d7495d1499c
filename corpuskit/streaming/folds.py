"""Sequential per-key folds: rate limiters and anchored quotas (T-01, T-02, T-03, T-09).

A limiter decision depends on the earlier *accepted* requests of the same key, so it is a
fold, not a window count. But a pause of at least the longest window leaves nothing of what
came before: every limiter starts afresh after it. A key's timeline is cut at such pauses, and
the segments fold in parallel, so a key that holds a third of all rows is dealt over many tasks.
Pauses are found without sorting a key in one task: requests are counted into slots of the
window's length, which hold no pause inside, and only slot ends are compared.

Batch form: hash-partition by (key, segment), sort inside each partition by (key, segment, time,
id) and stream every partition through the fold in Arrow batches. State per key is bounded (at
most ``limit`` timestamps, or two counters), rows are never gathered into a per-key array, and
the sort spills, so a segment without a pause costs time in one task but not memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import null_safe_join

US = 1_000_000


def segments(d: DataFrame, pause_us: int) -> DataFrame:
    """(key, t_us, ..) plus ``segment``: rises by one after every pause of at least ``pause_us`` in
    the times of a key. Two times of a slot of that length lie closer, so a pause ends at the first
    time of a slot; the table of slots has at most a row for each slot of a key, however many rows
    the key holds."""
    slotted = d.withColumn("_slot", F.col("t_us") - F.pmod("t_us", F.lit(pause_us)))
    slots = slotted.groupBy("key", "_slot").agg(F.min("t_us").alias("_first"), F.max("t_us").alias("_last"))
    w = Window.partitionBy("key").orderBy("_slot")
    fresh = F.coalesce((F.col("_first") - F.lag("_last").over(w) >= pause_us).cast("long"), F.lit(0))
    cut = slots.withColumn("_fresh", fresh).select("key", "_slot", F.sum("_fresh").over(w).alias("segment"))
    return null_safe_join(slotted, cut, ["key", "_slot"]).drop("_slot")


def _prep(df: DataFrame, key: str, ts: str, seq: str, partitions: int | None, pause_us: int) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..functions.time import epoch_micros
    d = df.select(F.col(key).cast("string").alias("key"), epoch_micros(df, ts).alias("t_us"), F.col(seq).cast("long").alias("seq"))
    return segments(d, pause_us).repartition(n, "key", "segment").sortWithinPartitions("key", "segment", "t_us", "seq")


def _runs(pdf: pd.DataFrame) -> list[tuple]:
    """What a fold runs over without a break: key and segment."""
    return list(zip(pdf["key"].astype(str), pdf["segment"]))


LIMIT_SCHEMA = ("key string, seq long, t_us long, allowed boolean, remaining int, current int, "
                "reset_at_us long, retry_after_us long")


def _sliding_log(limit: int, window_us: int):
    def run(it):
        cur, log = None, deque()
        for pdf in it:
            keys, ts, seqs, runs = pdf["key"].astype(str).to_numpy(), pdf["t_us"].to_numpy(), pdf["seq"].to_numpy(), _runs(pdf)
            n = len(pdf)
            allowed = np.zeros(n, dtype=bool)
            remaining = np.zeros(n, dtype=np.int32)
            current = np.zeros(n, dtype=np.int32)
            reset = np.zeros(n, dtype=np.int64)
            retry = np.zeros(n, dtype=np.int64)
            for i in range(n):
                if runs[i] != cur:
                    cur, log = runs[i], deque()
                now = int(ts[i])
                while log and log[0] <= now - window_us:  # keep t > now - window
                    log.popleft()
                c = len(log)
                if c < limit:
                    log.append(now)
                    allowed[i], remaining[i], current[i] = True, limit - c - 1, c + 1
                    reset[i] = log[0] + window_us  # D7: oldest entry in the window + window
                else:
                    current[i] = c
                    reset[i] = log[0] + window_us
                    retry[i] = max(0, log[0] + window_us - now)
            yield pd.DataFrame({"key": keys, "seq": seqs, "t_us": ts, "allowed": allowed, "remaining": remaining,
                                "current": current, "reset_at_us": reset, "retry_after_us": retry})
    return run


def sliding_log_limit(df: DataFrame, key: str, ts: str, seq: str, limit: int, window_s: float,
                      partitions: int | None = None) -> DataFrame:
    """T-01: accept iff fewer than ``limit`` accepted requests have ``t > now - window``.
    Denied requests do not enter the log. Ties in time are ordered by ``seq``. Entries
    older than the window are evicted as the fold advances (T-09)."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    d = _prep(df, key, ts, seq, partitions, max(1, int(window_s * US)))
    return d.mapInPandas(_sliding_log(limit, int(window_s * US)), LIMIT_SCHEMA)


MULTI_SCHEMA = "key string, seq long, t_us long, allowed boolean, failing_category string"


def _multi(rules: Sequence[tuple[str, int, int]]):
    def run(it):
        cur, logs = None, {}
        for pdf in it:
            keys, ts, seqs, runs = pdf["key"].astype(str).to_numpy(), pdf["t_us"].to_numpy(), pdf["seq"].to_numpy(), _runs(pdf)
            allowed, failing = [], []
            for i in range(len(pdf)):
                if runs[i] != cur:
                    cur, logs = runs[i], {c: deque() for c, _, _ in rules}
                now, ok, bad = int(ts[i]), True, None
                for cat, lim, win in rules:
                    log = logs[cat]
                    while log and log[0] <= now - win:
                        log.popleft()
                    if len(log) < lim:
                        log.append(now)  # earlier categories consume even if a later one denies
                    else:
                        ok, bad = False, cat
                        break
                allowed.append(ok)
                failing.append(bad)
            yield pd.DataFrame({"key": keys, "seq": seqs, "t_us": ts, "allowed": allowed, "failing_category": failing})
    return run


def multi_limit(df: DataFrame, key: str, ts: str, seq: str, rules: Sequence[tuple[str, int, float]],
                partitions: int | None = None) -> DataFrame:
    """T-02: several sliding-log limits checked in order; the first failing category is
    reported and later categories are not consumed. ``rules``: (category, limit, window_s);
    per-endpoint overrides are simply a different rule list per call."""
    r = [(c, int(lim), int(w * US)) for c, lim, w in rules]
    d = _prep(df, key, ts, seq, partitions, max(1, *[w for _, _, w in r]))
    return d.mapInPandas(_multi(r), MULTI_SCHEMA)


QUOTA_SCHEMA = "key string, seq long, t_us long, allowed boolean, reason string, minute_count int, day_count int"


def _anchored(rpm: int, rpd: int):
    minute, day = 60 * US, 86400 * US

    def run(it):
        cur = None
        ma = da = None
        mc = dc = 0
        for pdf in it:
            keys, ts, seqs, runs = pdf["key"].astype(str).to_numpy(), pdf["t_us"].to_numpy(), pdf["seq"].to_numpy(), _runs(pdf)
            allowed, reason, mcs, dcs = [], [], [], []
            for i in range(len(pdf)):
                if runs[i] != cur:
                    cur, ma, da, mc, dc = runs[i], None, None, 0, 0
                now = int(ts[i])
                why = None
                if ma is not None and now - ma < minute and mc >= rpm:
                    why = "per_minute"
                elif da is not None and now - da < day and dc >= rpd:
                    why = "per_day"
                if why is None:  # record: windows start at the first request after expiry
                    if ma is None or now - ma >= minute:
                        ma, mc = now, 0
                    if da is None or now - da >= day:
                        da, dc = now, 0
                    mc += 1
                    dc += 1
                allowed.append(why is None)
                reason.append(why)
                mcs.append(mc)
                dcs.append(dc)
            yield pd.DataFrame({"key": keys, "seq": seqs, "t_us": ts, "allowed": allowed, "reason": reason,
                                "minute_count": mcs, "day_count": dcs})
    return run


def anchored_quota(df: DataFrame, key: str, ts: str, seq: str, per_minute: int, per_day: int,
                   partitions: int | None = None) -> DataFrame:
    """T-03: per-tenant minute and day counters anchored at the first recorded request after
    the previous window expired (not clock boundaries); a request is denied when a live
    window is at quota; only allowed requests are recorded."""
    d = _prep(df, key, ts, seq, partitions, 86400 * US)
    return d.mapInPandas(_anchored(per_minute, per_day), QUOTA_SCHEMA)
