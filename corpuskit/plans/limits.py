"""Limiter and streaming queries over ``events`` (T family).

Streaming queries run their stream to completion (``availableNow``) over the events file and
return the sink table, so the stream and its batch twin are checked against the same SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import monitoring as MON
from ..session import checkpoint_dir, table
from ..streaming import folds as T
from ..streaming import stream as S
from .catalog import register
from .experiments import ASSIGN_SQL, MIN_SAMPLE, REQ_SQL, VARIANTS_SQL, _tests_sql, requests, sql_ts, ts_str

LIMIT, WINDOW_S = 3, 86400


def _fold_sql(limit: int, window_us: int) -> str:
    flt = f"list_filter(f.log, lambda x: x > e.t - {window_us})"
    return f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f(user_id, rn, event_id, log, allowed, remaining, cur) AS (
  SELECT user_id, rn, event_id, [t], true, {limit - 1}, 1 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id,
    CASE WHEN len({flt}) < {limit} THEN list_append({flt}, e.t) ELSE {flt} END,
    len({flt}) < {limit},
    CASE WHEN len({flt}) < {limit} THEN {limit} - len({flt}) - 1 ELSE 0 END,
    CASE WHEN len({flt}) < {limit} THEN len({flt}) + 1 ELSE len({flt}) END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS user_id, allowed,
  CAST(remaining AS INTEGER) AS remaining, CAST(cur AS INTEGER) AS current FROM f"""


LIMIT_SQL = _fold_sql(LIMIT, WINDOW_S * 1_000_000)


@register("rate_limit_decisions", LIMIT_SQL)
def rate_limit_decisions(spark, sf):
    """T-01 sliding-log limiter per user (3 per 24 h), batch fold over every event."""
    r = T.sliding_log_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", LIMIT, WINDOW_S)
    return r.select(F.col("seq").alias("request_id"), F.col("key").alias("user_id"), "allowed", "remaining", "current")


SLOTS = 8
#: Least rows of a file, where a landing has several.
FILE_ROWS = 100_000


def _unordered(spark, sf):
    """The events land in ``SLOTS`` landings, each out of order by up to a day (every event is moved by
    its hash), two to a micro-batch; a last row without user moves the watermark past them all. All
    landings have the same number of files, so that a micro-batch ends where a landing does: a part of
    a landing would move the watermark past rows of the rest."""
    path = checkpoint_dir(spark).rstrip("/") + f"/events-{uuid.uuid4().hex[:12]}"
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    moved = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000))
    e = e.withColumn("_at", moved)
    low, high = e.agg(F.min("_at"), F.max("_at")).first()
    slot = F.floor((F.col("_at") - low) * SLOTS / ((high or 0) - (low or 0) + 1)) if low is not None else F.lit(0)
    sizes = e.agg(*[F.count_if(slot == i) for i in range(SLOTS)]).first()
    files = max(1, min(sizes) // FILE_ROWS)  # dealt in turn, none is empty
    for i in range(SLOTS):
        e.filter(slot == i).drop("_at").repartition(files).write.mode("append").parquet(path)
    e.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(
        F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(e.schema["user_id"].dataType).alias("user_id"),
        F.col("ts").cast(e.schema["ts"].dataType)).dropna(subset="ts").write.mode("append").parquet(path)
    return spark.readStream.schema(e.drop("_at").schema).option("maxFilesPerTrigger", 2 * files).parquet(path)


@register("stream_rate_limit_decisions", LIMIT_SQL)
def stream_rate_limit_decisions(spark, sf):
    """T-01 / T-09 as a stateful stream over unordered files (same answer as the batch fold)."""
    s = S.streaming_sliding_log(_unordered(spark, sf), "user_id", "ts", "event_id", LIMIT, WINDOW_S, watermark="48 hours")
    r = S.run_to_table(s, "append", name="ratelimit").filter(F.col("key").isNotNull())
    return r.select(F.col("seq").alias("request_id"), F.col("key").alias("user_id"),
                                           "allowed", "remaining", "current")


MULTI_RULES = [("minute", 1, 60.0), ("hour", 2, 3600.0), ("day", 4, 86400.0)]


def _multi_sql(rules) -> str:
    """Recursive twin of T-02: one accepted-timestamp list per category, checked in order;
    an earlier category consumes even when a later one denies."""
    cols, steps = [], []
    prev_ok = "true"
    for i, (cat, lim, win) in enumerate(rules):
        w = int(win * 1_000_000)
        flt = f"list_filter(f.l{i}, lambda x: x > e.t - {w})"
        ok_i = f"({prev_ok} AND len({flt}) < {lim})"
        cols.append(f"l{i}")
        steps.append((flt, ok_i, prev_ok, cat))
        prev_ok = ok_i
    # first row of each user: every category has an empty log, so all accept (limits >= 1)
    init_cols = ", ".join("[t]" for _ in rules)
    step_cols = ", ".join(f"CASE WHEN {ok} THEN list_append({flt}, e.t) ELSE {flt} END" for flt, ok, _, _ in steps)
    fail = "CASE " + " ".join(f"WHEN {prev} AND NOT {ok} THEN '{cat}'" for flt, ok, prev, cat in steps) + " END"
    return f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f(user_id, rn, event_id, {', '.join(cols)}, failing) AS (
  SELECT user_id, rn, event_id, {init_cols}, CAST(NULL AS VARCHAR) FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, {step_cols}, {fail}
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id AS request_id, failing IS NULL AS allowed, failing AS failing_category FROM f"""


@register("multi_limit_decisions", _multi_sql(MULTI_RULES))
def multi_limit_decisions(spark, sf):
    """T-02 three limits checked in order per user; the first failing category is reported."""
    r = T.multi_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", MULTI_RULES)
    return r.select(F.col("seq").alias("request_id"), "allowed", "failing_category")


QUOTA_RPM, QUOTA_RPD = 1, 5
QUOTA_SQL = f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f(user_id, rn, event_id, ma, mc, da, dc, reason) AS (
  SELECT user_id, rn, event_id, t, 1, t, 1, CAST(NULL AS VARCHAR) FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id,
    CASE WHEN r IS NULL AND e_t - f_ma >= 60000000 THEN e_t ELSE f_ma END,
    CASE WHEN r IS NULL THEN (CASE WHEN e_t - f_ma >= 60000000 THEN 0 ELSE f_mc END) + 1 ELSE f_mc END,
    CASE WHEN r IS NULL AND e_t - f_da >= 86400000000 THEN e_t ELSE f_da END,
    CASE WHEN r IS NULL THEN (CASE WHEN e_t - f_da >= 86400000000 THEN 0 ELSE f_dc END) + 1 ELSE f_dc END,
    r
  FROM (SELECT e.user_id, e.rn, e.event_id, e.t AS e_t, f.ma AS f_ma, f.mc AS f_mc, f.da AS f_da, f.dc AS f_dc,
          CASE WHEN e.t - f.ma < 60000000 AND f.mc >= {QUOTA_RPM} THEN 'per_minute'
               WHEN e.t - f.da < 86400000000 AND f.dc >= {QUOTA_RPD} THEN 'per_day' END AS r
        FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) x)
SELECT event_id AS request_id, reason IS NULL AS allowed, reason, CAST(mc AS INTEGER) AS minute_count,
  CAST(dc AS INTEGER) AS day_count FROM f"""


@register("tenant_quota_decisions", QUOTA_SQL)
def tenant_quota_decisions(spark, sf):
    """T-03 anchored minute / day quotas per tenant (1 per minute, 5 per day)."""
    r = T.anchored_quota(table(spark, sf, "events"), "user_id", "ts", "event_id", QUOTA_RPM, QUOTA_RPD)
    return r.select(F.col("seq").alias("request_id"), "allowed", "reason", "minute_count", "day_count")


@register("stream_tenant_usage", f"""
SELECT user_id AS tenant_id, count(*) AS total_requests, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out,
  {sql_ts('max(ts)')} AS last_request FROM ({REQ_SQL}) GROUP BY user_id""")
def stream_tenant_usage(spark, sf):
    """T-04 running usage per tenant, streamed in update mode; the final state is returned."""
    ev = S.file_stream(spark, sf, "events")
    req = ev.select(F.col("user_id").alias("tenant_id"), "ts",
                    F.get_json_object("props", "$.k").cast("bigint").alias("tokens_in"),
                    F.floor("value").cast("bigint").alias("tokens_out"))
    r = S.run_to_table(S.running_usage(req), "update", keys=["tenant_id"], name="usage")
    return r.withColumn("last_request", ts_str("last_request"))


RATES_SQL = f"""
SELECT {sql_ts("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, event_type AS endpoint,
  CASE WHEN event_type <> 'error' THEN '2xx' ELSE '5xx' END AS status_class, count(*) AS increase,
  round(count(*) / 3600.0, 9) AS rate_per_s FROM events GROUP BY 1, 2, 3"""


def _rates_out(r):
    return r.select(ts_str("window_start").alias("window_start"), "endpoint", "status_class", "increase",
                    F.round("rate_per_s", 9).alias("rate_per_s"))


@register("hourly_rates", RATES_SQL)
def hourly_rates(spark, sf):
    """T-05 batch twin: hourly increase and rate per endpoint and status class."""
    return _rates_out(S.windowed_rates(requests(spark, sf).withColumnRenamed("event_type", "endpoint"), "1 hour",
                                       by="endpoint"))


@register("stream_hourly_rates", RATES_SQL)
def stream_hourly_rates(spark, sf):
    """T-05 streamed: tumbling hourly windows in update mode, so windows still open when the
    input ends are reported too (append mode would hold them until the watermark passes)."""
    ev = S.file_stream(spark, sf, "events")
    req = ev.select("ts", F.col("event_type").alias("endpoint"), (F.col("event_type") != "error").alias("success"))
    r = S.run_to_table(S.windowed_rates(req, "1 hour", watermark="1 hour"), "update",
                       keys=["window_start", "endpoint", "status_class"], name="rates")
    return _rates_out(r)


SLIDING_SQL = f"""
WITH r AS (SELECT event_type AS endpoint, ts, value / 100.0 AS v FROM events),
w AS (SELECT endpoint, v, time_bucket(INTERVAL 3 HOUR, ts) AS ws FROM r
      UNION ALL SELECT endpoint, v, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR FROM r),
g AS (SELECT ws, endpoint, count(*) AS count FROM w GROUP BY 1, 2),
b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'inf'::DOUBLE]) AS le),
h AS (SELECT g.ws, g.endpoint, b.le, g.count,
             (SELECT count(*) FROM w WHERE w.ws = g.ws AND w.endpoint = g.endpoint AND w.v <= b.le) AS cum FROM g, b),
q AS (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q),
x AS (SELECT h.*, q.q, lag(le) OVER k AS prev_le, lag(cum) OVER k AS prev_cum, q.q * count AS rank
      FROM h, q WINDOW k AS (PARTITION BY q.q, ws, endpoint ORDER BY le)),
f AS (SELECT ws, endpoint, q, arg_min(struct_pack(le := le, prev_le := prev_le, cum := cum, prev_cum := prev_cum, rank := rank), le) AS s
      FROM x WHERE cum >= rank AND count > 0 GROUP BY ws, endpoint, q)
SELECT {sql_ts('ws')} AS window_start, endpoint, q, round(CASE WHEN s.le = 'inf'::DOUBLE THEN s.prev_le
  WHEN s.cum - coalesce(s.prev_cum, 0) > 0 THEN coalesce(s.prev_le, 0) + (s.le - coalesce(s.prev_le, 0)) * (s.rank - coalesce(s.prev_cum, 0)) / (s.cum - coalesce(s.prev_cum, 0))
  ELSE s.le END, 6) AS value FROM f"""


@register("sliding_latency_quantiles", SLIDING_SQL)
def sliding_latency_quantiles(spark, sf):
    """T-06 p50 / p95 / p99 per 6-hour window sliding by 3 hours, from bucket counts."""
    req = requests(spark, sf).withColumn("latency_s", F.col("latency_ms") / 100.0).withColumnRenamed("event_type", "endpoint")
    wide = S.windowed_histogram(req, MON.DEFAULT_BOUNDS, "6 hours", "3 hours")
    h = S.histogram_rows(wide.withColumn("window_start", F.col("w.start")).drop("w"), MON.DEFAULT_BOUNDS,
                         ["window_start", "endpoint"])
    qs = [MON.bucket_quantile(h, q, ["window_start", "endpoint"]) for q in (0.5, 0.95, 0.99)]
    u = qs[0].unionByName(qs[1]).unionByName(qs[2])
    return u.select(ts_str("window_start").alias("window_start"), "endpoint", "q", F.round("value", 6).alias("value"))


#: An experiment stops when all variants have the sample and |z| of a treatment is over the two-tailed 5 % point.
STATUS_SQL = f"""
WITH t AS ({_tests_sql("latency_ms")}), a AS ({ASSIGN_SQL}),
n AS (SELECT v.experiment_id, min(coalesce(c.n, 0)) AS min_n FROM ({VARIANTS_SQL}) v
      LEFT JOIN (SELECT experiment_id, variant_id, count(*) AS n FROM a GROUP BY 1, 2) c ON v.experiment_id = c.experiment_id AND v.variant_id = c.variant_id GROUP BY 1)
SELECT n.experiment_id, n.min_n, CASE WHEN n.min_n >= {MIN_SAMPLE} AND max(abs(t.z_score)) > 1.959963984540054 THEN 'stopped' ELSE 'running' END AS status
FROM n JOIN t ON n.experiment_id = t.experiment_id GROUP BY n.experiment_id, n.min_n"""


@register("stream_variant_status", STATUS_SQL)
def stream_variant_status(spark, sf):
    """T-07 streaming variant moments (update mode) -> auto-stop decision per experiment."""
    from ..operators.experiments import assign_variants
    from .experiments import variants
    ev = S.file_stream(spark, sf, "events")
    req = ev.select(F.col("event_type").alias("experiment_id"), "user_id", (F.col("event_type") != "error").alias("success"),
                    F.col("value").alias("latency_ms"))
    v = variants(spark, sf)
    req = assign_variants(req, v)
    m = S.run_to_table(S.variant_moments_stream(req), "update", keys=["experiment_id", "variant_id"], name="variants")
    return S.auto_stop_status(m, v, MIN_SAMPLE).select("experiment_id", "min_n", "status")


@register("stream_validated_samples", """
WITH l AS (SELECT json_object('input', text, 'output', role)::VARCHAR AS line FROM conversations WHERE role <> 'system'
           UNION ALL SELECT json_object('input', text)::VARCHAR FROM conversations WHERE role = 'system'
           UNION ALL SELECT replace(text, chr(10), ' ') FROM documents WHERE trim(text) <> '')
SELECT CASE WHEN try(json(line)) IS NULL THEN 'invalid_json' WHEN json_extract_string(line, '$.output') IS NULL THEN 'missing_output'
  ELSE 'valid' END AS outcome, count(*) AS n FROM l GROUP BY 1""")
def stream_validated_samples(spark, sf):
    """T-08: conversation records (JSON) and document texts (not JSON) land as JSONL files;
    the stream splits them into samples and quarantined rejects."""
    base = checkpoint_dir(spark).rstrip("/") + f"/jsonl-{uuid.uuid4().hex[:12]}"
    c = table(spark, sf, "conversations")
    recs = c.select(F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("input"))))
                    .otherwise(F.to_json(F.struct(F.col("text").alias("input"), F.col("role").alias("output")))).alias("value"))
    docs = table(spark, sf, "documents").filter(F.trim("text") != "").select(
        F.regexp_replace("text", "\n", " ").alias("value"))
    recs.unionByName(docs).write.mode("overwrite").text(base + "/in")
    q = S.validated_sample_stream(spark, base + "/in", base + "/good", base + "/bad", base + "/ckpt", max_files=4)
    q.awaitTermination()
    good = spark.read.schema("input string, output string, source_file string, _batch long").json(base + "/good")
    bad = spark.read.schema("value string, reason string, source_file string, _batch long").json(base + "/bad")
    g = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("outcome"), "n")
    b = bad.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return g.unionByName(b).filter(F.col("n") > 0)


@register("stream_tenant_quota_decisions", QUOTA_SQL)
def stream_tenant_quota_decisions(spark, sf):
    """T-03 as a stateful stream over unordered files (same answer as the batch fold)."""
    s = S.streaming_anchored_quota(_unordered(spark, sf), "user_id", "ts", "event_id", QUOTA_RPM, QUOTA_RPD, watermark="48 hours")
    r = S.run_to_table(s, "append", name="quota").filter(F.col("key").isNotNull())
    return r.select(F.col("seq").alias("request_id"), "allowed", "reason", "minute_count", "day_count")


@register("stream_multi_limit_decisions", _multi_sql(MULTI_RULES))
def stream_multi_limit_decisions(spark, sf):
    """T-02 as a stateful stream over unordered files (same answer as the batch fold)."""
    s = S.streaming_multi_limit(_unordered(spark, sf), "user_id", "ts", "event_id", MULTI_RULES, watermark="48 hours")
    r = S.run_to_table(s, "append", name="multi").filter(F.col("key").isNotNull())
    return r.select(F.col("seq").alias("request_id"), "allowed", "failing_category")
