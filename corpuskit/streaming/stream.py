"""Structured Streaming forms (T-01, T-04 ... T-08) and a runner that materialises a stream
into a table in the shared checkpoint folder.

Streams are event-time: every stateful operator takes a watermark; state is evicted when the
watermark passes it (T-09). Limiters settle an event when the watermark passes it, so that
their decisions do not depend on micro-batches.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import py_strip
from ..session import checkpoint_dir, table

US = 1_000_000


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """S-03 style incremental read of one driver table (schema taken from the batch file)."""
    schema = table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def run_to_table(stream: DataFrame, output_mode: str = "append", keys: list[str] | None = None,
                 name: str = "stream", settings: dict | None = None) -> DataFrame:
    """Run ``stream`` until all available input is processed (``availableNow``), writing
    every micro-batch to parquet under the shared checkpoint folder, and return the result
    as a batch DataFrame. For ``update`` mode the newest row per ``keys`` wins. ``settings``
    hold for this stream alone."""
    spark = stream.sparkSession
    base = checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:12]}"
    out = base + "/data"

    def sink(batch: DataFrame, batch_id: int):
        # idempotent: a re-run of the same micro-batch (task or executor loss) overwrites its folder
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
             .option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    finally:  # a started stream has its own copy
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    if q.lastProgress is None and not q.recentProgress:  # no batch ran: no input at all
        return spark.createDataFrame([], stream.schema)
    res = spark.read.parquet(out)
    if output_mode == "update" and keys:
        cols = [c for c in res.columns if c not in keys and c != "_batch"]
        res = res.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r")).select(
            *keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return res.drop("_batch")


# ------------------------------------------------------------------ T-01 / T-09 streaming limiter

class SlidingLog:
    """T-01 step: accepted times of the window. ``memo`` is what the state keeps (longs)."""

    def __init__(self, memo, limit: int, window: int):
        self.log, self.limit, self.window = deque(memo), limit, window

    def step(self, t: int) -> tuple:
        while self.log and self.log[0] <= t - self.window:
            self.log.popleft()
        n = len(self.log)
        if n < self.limit:
            self.log.append(t)
            return True, self.limit - n - 1, n + 1
        return False, 0, n

    def memo(self) -> list[int]:
        return list(self.log)

    def live_until(self) -> int:
        return self.log[-1] + self.window if self.log else 0


class AnchoredQuota:
    """T-03 step: (anchor, count) of the minute and of the day; anchor -1 means none yet."""

    def __init__(self, memo, per_minute: int, per_day: int):
        self.windows = [list(memo[i:i + 2]) or [-1, 0] for i in (0, 2)]
        self.rules = (("per_minute", 60 * US, per_minute), ("per_day", 86400 * US, per_day))

    def step(self, t: int) -> tuple:
        why = next((name for (anchor, n), (name, size, most) in zip(self.windows, self.rules)
                    if anchor >= 0 and t - anchor < size and n >= most), None)
        if why is None:
            for w, (_, size, _) in zip(self.windows, self.rules):
                if w[0] < 0 or t - w[0] >= size:
                    w[:] = [t, 0]
                w[1] += 1
        return why is None, why, self.windows[0][1], self.windows[1][1]

    def memo(self) -> list[int]:
        return [*self.windows[0], *self.windows[1]]

    def live_until(self) -> int:
        return max(w[0] + size for w, (_, size, _) in zip(self.windows, self.rules) if w[0] >= 0) if self.windows[1][0] >= 0 else 0


class MultiLimit:
    """T-02 step: accepted times of every category in turn, each list after its length."""

    def __init__(self, memo, rules: list[tuple[str, int, int]]):
        self.rules, self.logs, memo = rules, [], list(memo)
        for _ in rules:
            n = memo[0] if memo else 0
            self.logs.append(deque(memo[1:1 + n]))
            memo = memo[1 + n:]

    def step(self, t: int) -> tuple:
        for log, (category, limit, window) in zip(self.logs, self.rules):
            while log and log[0] <= t - window:
                log.popleft()
            if len(log) >= limit:
                return False, category
            log.append(t)  # earlier categories consume even if a later one denies
        return True, None

    def memo(self) -> list[int]:
        return [x for log in self.logs for x in (len(log), *log)]

    def live_until(self) -> int:
        return max((log[-1] + window for log, (_, _, window) in zip(self.logs, self.rules) if log), default=0)


#: Groups that keys are dealt to by hash. A group shares one call and one state row in a micro-batch,
#: so the calls stay bounded however many keys there are.
GROUPS = 512
#: Decisions given out in one frame.
ROWS_OUT = 1 << 16
STATE = "keys array<string>, memos array<array<long>>, owners array<int>, times array<long>, seqs array<long>"


def _settled(events: DataFrame, key: str, ts: str, seq: str, watermark: str, out: str, machine, groups: int = GROUPS) -> DataFrame:
    """Per key, fold events in (time, seq) order once the watermark has passed them.

    Until then they wait in the state, so the outcome does not depend on how events fall into
    micro-batches: every event that is not older than the watermark when it arrives counts, in
    its place. The state of a group of keys holds, for each key, what its machine keeps, and the
    waiting events. A timeout at the earliest waiting event, or the earliest end of a key's last
    window, brings the group back; a key with neither is dropped (T-09). Events older than the
    watermark are dropped by Spark before they reach the state. A NULL ``seq`` counts as -1.
    """
    from ..functions.time import epoch_micros, utc_instant
    d = events.select(F.col(key).cast("string").alias("key"), utc_instant(events, ts).alias("ts"),
                      epoch_micros(events, ts).alias("t_us"), F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias("seq")).withWatermark("ts", watermark)
    d = d.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    names = [f.split()[0] for f in out.split(", ")]

    def fold(k, pdfs, state):
        keys, memos, *waiting = state.get if state.exists else ([], [], [], [], [])
        keys, memos, known = list(keys), list(memos), {name: i for i, name in enumerate(keys)}
        parts = [[np.asarray(x, np.int64) for x in waiting]]
        if not state.hasTimedOut:
            for pdf in pdfs:
                owners = np.fromiter((known.setdefault(name, len(known)) for name in pdf["key"]), np.int64, len(pdf))
                parts.append([owners, pdf["t_us"].to_numpy(np.int64), pdf["seq"].to_numpy(np.int64)])
        keys = list(known)
        owners, times, seqs = (np.concatenate(x) for x in zip(*parts))
        mark = state.getCurrentWatermarkMs()
        due = times // 1000 <= mark
        order = np.flatnonzero(due)
        order = order[np.lexsort((seqs[order], times[order]))]
        machines = [machine(memo) for memo in memos] + [machine([]) for _ in keys[len(memos):]]
        for at in range(0, len(order), ROWS_OUT):
            part = order[at:at + ROWS_OUT]
            yield pd.DataFrame([(keys[o], s, t, *machines[o].step(t)) for o, t, s in zip(
                owners[part].tolist(), times[part].tolist(), seqs[part].tolist())], columns=names)
        owners, times, seqs = owners[~due], times[~due], seqs[~due]
        ends = np.fromiter((m.live_until() // 1000 for m in machines), np.int64, len(machines))
        stays = ends > mark
        soon = np.concatenate([ends[stays], times // 1000])
        stays[owners] = True
        if stays.any():
            number = np.cumsum(stays) - 1
            state.update(([name for name, x in zip(keys, stays) if x], [m.memo() for m, x in zip(machines, stays) if x],
                          number[owners].tolist(), times.tolist(), seqs.tolist()))
            state.setTimeoutTimestamp(int(soon.min()))
        elif state.exists:
            state.remove()
        if not len(order):
            yield pd.DataFrame([], columns=names)

    return d.groupBy("_group").applyInPandasWithState(fold, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def streaming_sliding_log(events: DataFrame, key: str, ts: str, seq: str, limit: int, window_s: float,
                          watermark: str = "1 hour") -> DataFrame:
    """T-01 as a stateful stream; of a key the state holds the events ahead of the watermark and at most
    ``limit`` accepted times."""
    win = int(window_s * US)
    return _settled(events, key, ts, seq, watermark, "key string, seq long, t_us long, allowed boolean, remaining int, current int",
                    lambda memo: SlidingLog(memo, limit, win))


def streaming_anchored_quota(events: DataFrame, key: str, ts: str, seq: str, per_minute: int, per_day: int,
                             watermark: str = "1 hour") -> DataFrame:
    """T-03 as a stateful stream: windows start at the first recorded request after expiry; denied
    requests are not recorded."""
    return _settled(events, key, ts, seq, watermark,
                    "key string, seq long, t_us long, allowed boolean, reason string, minute_count int, day_count int",
                    lambda memo: AnchoredQuota(memo, per_minute, per_day))


#: For states that outgrow an executor's memory: kept on its disk.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def streaming_multi_limit(events: DataFrame, key: str, ts: str, seq: str, rules, watermark: str = "1 hour") -> DataFrame:
    """T-02 as a stateful stream: several sliding-log limits in order; events are settled in (time,
    seq) order once the watermark has passed them. A NULL key is a key."""
    r = [(c, int(n), int(w * US)) for c, n, w in rules]
    return _settled(events, key, ts, seq, watermark, "key string, seq long, t_us long, allowed boolean, failing_category string",
                    lambda memo: MultiLimit(memo, r))


# ------------------------------------------------------------------ T-04 / T-05 / T-06 / T-07

def running_usage(requests: DataFrame, key: str = "tenant_id") -> DataFrame:
    """T-04: running totals per tenant (``update`` output mode)."""
    return requests.groupBy(key).agg(F.count(F.lit(1)).alias("total_requests"), F.sum("tokens_in").alias("total_tokens_in"),
                                     F.sum("tokens_out").alias("total_tokens_out"), F.max("ts").alias("last_request"))


def status_class(success) -> F.Column:
    return F.when(success, F.lit("2xx")).otherwise(F.lit("5xx"))


def windowed_rates(requests: DataFrame, size: str, slide: str | None = None, watermark: str = "10 minutes",
                   by: str = "endpoint") -> DataFrame:
    """T-05: event counts and per-second rate per (window, endpoint, status class).

    Rates are counts / window seconds (no extrapolation). Works on a stream (append mode,
    finalised by the watermark) and on a batch frame alike."""
    from ..functions.time import to_ntz, utc_instant
    d = requests.withColumn("_et", utc_instant(requests, "ts"))
    if d.isStreaming:
        d = d.withWatermark("_et", watermark)
    w = F.window("_et", size, slide) if slide else F.window("_et", size)
    a = d.groupBy(w.alias("w"), F.col(by).alias("endpoint"), status_class(F.col("success")).alias("status_class")) \
        .agg(F.count(F.lit(1)).alias("increase"))
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return a.select(to_ntz(F.col("w.start")).alias("window_start"), to_ntz(F.col("w.end")).alias("window_end"), "endpoint",
                    "status_class", "increase", (F.col("increase") / secs).alias("rate_per_s"))


def windowed_histogram(requests: DataFrame, bounds, size: str, slide: str, by: str = "endpoint",
                       value: str = "latency_s", watermark: str = "10 minutes") -> DataFrame:
    """T-06 first half: cumulative bucket counts per sliding window (one aggregation)."""
    from ..functions.time import to_ntz, utc_instant
    d = requests.withColumn("_et", utc_instant(requests, "ts"))
    if d.isStreaming:
        d = d.withWatermark("_et", watermark)
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    a = d.groupBy(F.window("_et", size, slide).alias("w"), F.col(by).alias("endpoint")).agg(
        *aggs, F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"))
    return a.withColumn("w", F.struct(to_ntz(F.col("w.start")).alias("start"), to_ntz(F.col("w.end")).alias("end")))


def histogram_rows(wide: DataFrame, bounds, group) -> DataFrame:
    les = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(bounds)]
    les.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cum")))
    return wide.select(*group, "count", "sum", F.explode(F.array(*les)).alias("x")).select(*group, "x.le", "x.cum", "count", "sum")


def variant_moments_stream(requests: DataFrame) -> DataFrame:
    """T-07 streaming part: per-variant count, mean and sample variance of the latency. Spark keeps
    the mean and the sum of squared deviations from it, and merges these between micro-batches, so
    nothing cancels for latencies that are large against their spread."""
    return requests.groupBy("experiment_id", "variant_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean"), F.var_samp("latency_ms").alias("var"),
        F.count_if("success").alias("successes"))


def auto_stop_status(moments: DataFrame, variants: DataFrame, min_sample: int, confidence: float = 0.95) -> DataFrame:
    """T-07 decision on the current moments: stop once every variant has ``min_sample``
    requests and any treatment differs significantly from its control (latency)."""
    from ..operators.experiments import compare_variants
    m = moments.select("experiment_id", "variant_id", "n", "mean", F.coalesce("var", F.lit(0.0)).alias("var"))
    c = compare_variants(m, variants, "latency_ms", confidence)
    n_ok = variants.join(moments, ["experiment_id", "variant_id"], "left").groupBy("experiment_id").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("min_n"))
    sig = c.groupBy("experiment_id").agg(F.max(F.col("is_significant").cast("int")).alias("any_sig"))
    return n_ok.join(sig, "experiment_id", "left").withColumn(
        "status", F.when((F.col("min_n") >= min_sample) & (F.coalesce("any_sig", F.lit(0)) == 1), F.lit("stopped"))
        .otherwise(F.lit("running")))


def validated_sample_stream(spark: SparkSession, src_dir: str, good_dir: str, bad_dir: str,
                            checkpoint: str, max_files: int = 1):
    """T-08: JSONL files arriving in ``src_dir`` -> valid samples to ``good_dir``, rejects with
    a reason to ``bad_dir`` (one pass per micro-batch); returns the started query."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(src_dir) \
        .withColumn("source_file", F.col("_metadata.file_path"))

    def split(batch: DataFrame, _bid: int):
        from ..functions.jsonl import parse_json_strict
        v = parse_json_strict("value")
        d = batch.filter(py_strip("value") != "").select(
            "source_file", "value", F.try_variant_get(v, "$.input", "string").alias("input"),
            F.try_variant_get(v, "$.output", "string").alias("output"), v.isNull().alias("bad_json"))
        d = d.withColumn("reason", F.when(F.col("bad_json"), "invalid_json").when(F.col("input").isNull(), "missing_input")
                         .when(F.col("output").isNull(), "missing_output"))
        d.persist()
        # one folder per micro-batch, overwritten on a re-run: retried batches never duplicate rows
        d.filter(F.col("reason").isNull()).select("input", "output", "source_file").write.mode("overwrite") \
            .json(f"{good_dir}/_batch={_bid}")
        d.filter(F.col("reason").isNotNull()).select("value", "reason", "source_file").write.mode("overwrite") \
            .json(f"{bad_dir}/_batch={_bid}")
        d.unpersist()

    return lines.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
