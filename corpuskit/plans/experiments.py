"""Event-table queries: requests, experiments, quotas, monitoring and ordering.

``events`` is read as request traffic: success = not an ``error`` event, latency_ms =
value, tokens_in = props.k, tokens_out = floor(value); each event type is one experiment
and each user one tenant.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as X
from ..operators import monitoring as MON
from ..operators import ranking as W
from ..operators import relate as J
from ..operators import stats as A
from ..operators.ordered import running_sum_split
from ..session import table
from .catalog import register

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts_str(c):
    return F.date_format(F.col(c), TS_FMT)


def sql_ts(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def requests(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("experiment_id"), "user_id", "ts",
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_in"),
        F.floor("value").cast("bigint").alias("tokens_out"), "event_type")


REQ_SQL = """SELECT event_id AS request_id, event_type AS experiment_id, user_id, ts, event_type <> 'error' AS success,
  value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in,
  CAST(floor(value) AS BIGINT) AS tokens_out, event_type FROM events"""

# Variant template every experiment uses (name, control flag, allocation %).
VARIANT_TEMPLATE = [("control", True, 50.0), ("treatment_a", False, 30.0), ("treatment_b", False, 20.0)]
MIN_SAMPLE = 100


def _experiment_ids(spark, sf):
    """One row per experiment (event type), however many there are."""
    return table(spark, sf, "events").select(F.col("event_type").alias("experiment_id")).dropna().distinct()


def variants(spark, sf):
    """The template's variants of every experiment."""
    template = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("is_control"), F.lit(p).alias("percentage"),
                                  F.lit(i).alias("variant_seq"), F.lit(i).alias("seq"))
                         for i, (n, c, p) in enumerate(VARIANT_TEMPLATE)])
    v = _experiment_ids(spark, sf).select("experiment_id", F.explode(template).alias("v"))
    return v.select("experiment_id", F.concat_ws("/", "experiment_id", "v.name").alias("variant_id"), "v.*")


def experiments(spark, sf):
    return _experiment_ids(spark, sf).select("experiment_id", F.lit(MIN_SAMPLE).alias("min_sample_size"),
                                             F.lit(0.95).alias("confidence_level"))


VARIANTS_SQL = """SELECT e.experiment_id, e.experiment_id || '/' || t.name AS variant_id, t.name, t.is_control,
  t.percentage, t.variant_seq FROM (SELECT DISTINCT event_type AS experiment_id FROM events) e,
  (VALUES (0, 'control', true, 50.0), (1, 'treatment_a', false, 30.0), (2, 'treatment_b', false, 20.0))
  t(variant_seq, name, is_control, percentage)"""


def assigned(spark, sf):
    return X.assign_variants(requests(spark, sf), variants(spark, sf))


ASSIGN_SQL = f"""
WITH r AS ({REQ_SQL}),
b AS (SELECT *, (('0x' || substr(sha256(CAST(user_id AS VARCHAR) || ':' || experiment_id), 1, 8))::BIGINT % 10000) / 100.0 AS bucket FROM r),
v AS ({VARIANTS_SQL}),
a AS (SELECT *, sum(percentage) OVER (PARTITION BY experiment_id ORDER BY variant_seq) AS hi FROM v)
SELECT b.*, a.variant_id FROM b LEFT JOIN a ON b.experiment_id = a.experiment_id AND b.bucket >= a.hi - a.percentage AND b.bucket < a.hi"""


@register("variant_assignment", f"SELECT request_id, experiment_id, user_id, round(bucket, 2) AS bucket, variant_id FROM ({ASSIGN_SQL})")
def variant_assignment(spark, sf):
    """J-08 hash-bucket variant assignment through a range join on cumulative shares."""
    return assigned(spark, sf).select("request_id", "experiment_id", "user_id", F.round("bucket", 2).alias("bucket"), "variant_id")


ROLLUP_SQL = f"""
WITH a AS ({ASSIGN_SQL})
SELECT experiment_id, variant_id, count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count,
  count(*) FILTER (WHERE NOT success) AS error_count, round(sum(latency_ms), 6) AS total_latency_ms,
  round(sum(latency_ms) / count(*), 6) AS avg_latency_ms, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms,
  round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out, round(sum(tokens_in) / count(*), 6) AS avg_tokens_in,
  round(sum(tokens_out) / count(*), 6) AS avg_tokens_out,
  round(CASE WHEN sum(latency_ms) > 0 THEN sum(tokens_out) * 1000.0 / sum(latency_ms) ELSE 0 END, 6) AS tokens_per_second,
  {sql_ts('max(ts)')} AS last_updated
FROM a GROUP BY experiment_id, variant_id"""


@register("variant_rollup", ROLLUP_SQL)
def variant_rollup(spark, sf):
    """A-09 per-variant rollup (unrounded values shown to 6 places)."""
    r = X.variant_rollup(assigned(spark, sf), rounded=False)
    dbl = ["total_latency_ms", "avg_latency_ms", "success_rate", "avg_tokens_in", "avg_tokens_out", "tokens_per_second"]
    return r.select(*[F.round(c, 6).alias(c) if c in dbl else (ts_str(c).alias(c) if c == "last_updated" else F.col(c))
                      for c in r.columns])


def _tests_sql(metric: str) -> str:
    x = "latency_ms" if metric == "latency_ms" else "CAST(success AS DOUBLE)"
    return f"""
WITH a AS ({ASSIGN_SQL}),
m AS (SELECT experiment_id, variant_id, count(*) AS n, avg({x}) AS mean, coalesce(var_samp({x}), 0) AS var FROM a GROUP BY 1, 2),
v AS (SELECT v.experiment_id, v.variant_id, v.is_control, coalesce(m.n, 0) AS n, coalesce(m.mean, 0) AS mean, coalesce(m.var, 0) AS var
      FROM ({VARIANTS_SQL}) v LEFT JOIN m ON v.experiment_id = m.experiment_id AND v.variant_id = m.variant_id),
d AS (SELECT t.experiment_id, t.variant_id, c.variant_id AS control_id, c.n AS n1, t.n AS n2, c.mean AS m1, t.mean AS m2,
             c.var AS v1, t.var AS v2, c.n >= 2 AND t.n >= 2 AS ok, sqrt(t.var / t.n + c.var / c.n) AS se,
             sqrt(((c.n - 1) * c.var + (t.n - 1) * t.var) / (c.n + t.n - 2)) AS pooled
      FROM v t JOIN v c ON t.experiment_id = c.experiment_id AND c.is_control AND NOT t.is_control),
e AS (SELECT *, CASE WHEN ok AND se > 0 THEN (m2 - m1) / se ELSE 0 END AS z,
             CASE WHEN ok AND pooled > 0 THEN (m2 - m1) / pooled ELSE 0 END AS eff FROM d),
q AS (SELECT sqrt(-2 * ln(1 - 0.975)) AS t),
zc AS (SELECT t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS zc FROM q)
SELECT experiment_id, variant_id, control_id, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(z, 6) AS z_score,
  round(eff, 6) AS effect_size,
  round(CASE WHEN ok THEN eff - zc * sqrt((n1 + n2) / (n1 * n2) + eff * eff / (2 * (n1 + n2))) ELSE 0 END, 6) AS ci_lower,
  round(CASE WHEN ok THEN eff + zc * sqrt((n1 + n2) / (n1 * n2) + eff * eff / (2 * (n1 + n2))) ELSE 0 END, 6) AS ci_upper,
  ok AND NOT (se > 0) AND m1 <> m2 AS degenerate_variance
FROM e, zc"""


def _tests(spark, sf, metric):
    from ..session import cut_lineage
    moments = cut_lineage(X.metric_moments(assigned(spark, sf), metric))  # few rows, read twice below
    c = X.compare_variants(moments, variants(spark, sf), metric, with_p=False)
    return c.select("experiment_id", "variant_id", "control_id", "n1", "n2", F.round("mean1", 6).alias("mean1"),
                    F.round("mean2", 6).alias("mean2"), *[F.round(x, 6).alias(x) for x in ("z_score", "effect_size", "ci_lower", "ci_upper")],
                    "degenerate_variance")


@register("variant_tests_latency", _tests_sql("latency_ms"))
def variant_tests_latency(spark, sf):
    """A-10 z, Cohen's d and CI (X-09 inverse normal CDF) of latency, each treatment vs control."""
    return _tests(spark, sf, "latency_ms")


@register("variant_tests_success", _tests_sql("success_rate"))
def variant_tests_success(spark, sf):
    """A-10 on success rate (variance of the success indicator, D5)."""
    return _tests(spark, sf, "success_rate")


@register("experiment_verdicts")
def experiment_verdicts(spark, sf):
    """A-10 p-values / winners and A-11 verdicts (X-09 normal CDF via Arrow kernel: no SQL oracle)."""
    v = X.analyze_experiment(assigned(spark, sf), variants(spark, sf), experiments(spark, sf), "latency_ms")
    return v.select("experiment_id", F.to_json("sample_sizes").alias("sample_sizes"), "min_n", "sufficient_sample_size",
                    "winner_name", "recommendation", "recommendation_text")


@register("required_sample_sizes", f"""
WITH a AS ({ASSIGN_SQL}),
b AS (SELECT experiment_id, count(*) FILTER (WHERE success) / count(*) AS baseline_rate FROM a
      WHERE variant_id = experiment_id || '/control' GROUP BY experiment_id),
k AS (SELECT sqrt(-2 * ln(1 - 0.975)) AS ta, sqrt(-2 * ln(1 - 0.8)) AS tb),
z AS (SELECT ta - (2.515517 + 0.802853 * ta + 0.010328 * ta * ta) / (1 + 1.432788 * ta + 0.189269 * ta * ta + 0.001308 * ta * ta * ta) AS za,
             tb - (2.515517 + 0.802853 * tb + 0.010328 * tb * tb) / (1 + 1.432788 * tb + 0.189269 * tb * tb + 0.001308 * tb * tb * tb) AS zb FROM k),
p AS (SELECT experiment_id, baseline_rate, baseline_rate * 1.05 AS t, (baseline_rate + baseline_rate * 1.05) / 2 AS pp FROM b)
SELECT experiment_id, round(baseline_rate, 6) AS baseline_rate,
  CASE WHEN abs(t - baseline_rate) = 0 THEN NULL ELSE CAST(ceil(2 * pp * (1 - pp) * pow((za + zb) / abs(t - baseline_rate), 2)) AS BIGINT) END AS required_n
FROM p, z""")
def required_sample_sizes(spark, sf):
    """A-12 required n per variant from each experiment's control success rate (+5 % MDE)."""
    a = assigned(spark, sf).filter(F.col("variant_id") == F.concat(F.col("experiment_id"), F.lit("/control")))
    b = a.groupBy("experiment_id").agg((F.count_if("success") / F.count(F.lit(1))).alias("baseline_rate"))
    r = X.required_sample_size(b, "baseline_rate", 0.05)
    return r.select("experiment_id", F.round("baseline_rate", 6).alias("baseline_rate"), "required_n")


@register("allocation_violations", f"""
WITH v AS ({VARIANTS_SQL})
SELECT experiment_id, 'percentages_do_not_sum_to_100' AS violation FROM v GROUP BY experiment_id HAVING abs(sum(percentage) - 100) > 0.1
UNION ALL SELECT experiment_id, 'not_exactly_one_control' FROM v GROUP BY experiment_id HAVING count(*) FILTER (WHERE is_control) <> 1""")
def allocation_violations(spark, sf):
    """A-13 allocation checks for every experiment (the template is valid: expect none)."""
    v = variants(spark, sf)
    return X.allocation_violations(v, v.select("experiment_id", "variant_id", "percentage"))


def points(spark, sf):
    """Events as metric points: counter ``events_total`` / value, labels {type, band}."""
    e = table(spark, sf, "events")
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("band"),
                          F.when(F.col("value") >= 100, F.lit("high")).otherwise(F.lit("low")))
    return e.select(F.lit("events_total").alias("name"), labels.alias("labels"), "value", "ts", "event_id", "event_type")


@register("counter_rollup", """
SELECT 'events_total' AS name, event_type AS type, CASE WHEN value >= 100 THEN 'high' ELSE 'low' END AS band,
  round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3""")
def counter_rollup(spark, sf):
    """A-14 counter totals per full label set."""
    r = MON.counter_rollup(points(spark, sf))
    m = F.map_from_entries("label_set")
    return r.select("name", m["type"].alias("type"), m["band"].alias("band"), F.round("total", 6).alias("total"))


@register("counter_match_total", "SELECT round(sum(value), 6) AS total FROM events WHERE event_type = 'click'")
def counter_match_total(spark, sf):
    """A-14 counter total over a label subset ({type: click})."""
    return MON.counter_total(points(spark, sf), "events_total", {"type": "click"}).select(F.round("total", 6).alias("total"))


@register("gauge_last", """
SELECT event_type AS type, band, arg_max(value, (ts, event_id)) AS value FROM
  (SELECT *, CASE WHEN value >= 100 THEN 'high' ELSE 'low' END AS band FROM events) GROUP BY 1, 2""")
def gauge_last(spark, sf):
    """A-15 last value per label set."""
    g = MON.gauge_last(points(spark, sf), seq="event_id")
    m = F.map_from_entries("label_set")
    return g.select(m["type"].alias("type"), m["band"].alias("band"), "value")


HIST_BOUNDS = MON.DEFAULT_BOUNDS


def _hist(spark, sf):
    p = points(spark, sf).withColumn("value", F.col("value") / 100.0)
    return MON.histogram(p, HIST_BOUNDS, ["event_type"])


HIST_SQL = f"""
WITH b AS (SELECT unnest([{', '.join(str(float(b)) for b in HIST_BOUNDS)}, 'inf'::DOUBLE]) AS le),
p AS (SELECT event_type, value / 100.0 AS v FROM events),
g AS (SELECT event_type, count(*) AS count, sum(v) AS sum FROM p GROUP BY event_type)
SELECT g.event_type, b.le, (SELECT count(*) FROM p WHERE p.event_type = g.event_type AND p.v <= b.le) AS cum, g.count, round(g.sum, 6) AS sum
FROM g, b"""


@register("latency_histogram", HIST_SQL)
def latency_histogram(spark, sf):
    """A-16 cumulative histogram (default bounds, +Inf) per event type."""
    return _hist(spark, sf).withColumn("sum", F.round("sum", 6))


@register("latency_quantiles", f"""
WITH h AS ({HIST_SQL}), q AS (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q),
x AS (SELECT h.*, q.q, lag(le) OVER w AS prev_le, lag(cum) OVER w AS prev_cum, q.q * count AS rank
      FROM h, q WINDOW w AS (PARTITION BY q.q, event_type ORDER BY le)),
f AS (SELECT event_type, q, arg_min(struct_pack(le := le, prev_le := prev_le, cum := cum, prev_cum := prev_cum, rank := rank), le) AS s
      FROM x WHERE cum >= rank AND count > 0 GROUP BY event_type, q)
SELECT event_type, q, round(CASE WHEN s.le = 'inf'::DOUBLE THEN s.prev_le
  WHEN s.cum - coalesce(s.prev_cum, 0) > 0 THEN coalesce(s.prev_le, 0) + (s.le - coalesce(s.prev_le, 0)) * (s.rank - coalesce(s.prev_cum, 0)) / (s.cum - coalesce(s.prev_cum, 0))
  ELSE s.le END, 6) AS value FROM f""")
def latency_quantiles(spark, sf):
    """A-17 p50 / p95 / p99 per event type from bucket counts (linear interpolation)."""
    h = _hist(spark, sf)
    parts = [MON.bucket_quantile(h, q, ["event_type"]) for q in (0.5, 0.95, 0.99)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.withColumn("value", F.round("value", 6))


@register("tenant_usage", f"""
SELECT user_id AS tenant_id, count(*) AS total_requests, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out,
  {sql_ts('max(ts)')} AS last_request FROM ({REQ_SQL}) GROUP BY user_id""")
def tenant_usage(spark, sf):
    """A-18 usage totals per tenant (user)."""
    u = A.tenant_usage(requests(spark, sf).withColumnRenamed("user_id", "tenant_id"))
    return u.withColumn("last_request", ts_str("last_request"))


@register("batch_outcomes", """
SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful,
  count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""")
def batch_outcomes(spark, sf):
    """A-28 batch result split: error events are the failed items."""
    e = table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", F.col("props")))
    return A.batch_split(e)[2]


@register("newest_errors", f"""
SELECT event_id, user_id, {sql_ts('ts')} AS ts FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 20""")
def newest_errors(spark, sf):
    """W-01 filter -> newest first -> limit 20 (a top-k report)."""
    e = table(spark, sf, "events")
    return W.newest(e, "ts", 20, tie="event_id", where=F.col("event_type") == "error").select(
        "event_id", "user_id", ts_str("ts").alias("ts"))


@register("newest_latencies", f"""
WITH a AS ({ASSIGN_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, variant_id ORDER BY ts DESC NULLS LAST, request_id DESC) AS rank FROM a WHERE success)
SELECT experiment_id, variant_id, request_id, latency_ms, rank FROM r WHERE rank <= 50""")
def newest_latencies(spark, sf):
    """W-02 newest 50 successful latencies per (experiment, variant)."""
    r = W.newest_per_group(assigned(spark, sf), ["experiment_id", "variant_id"], "ts", 50, tie="request_id",
                           where=F.col("success"))
    return r.select("experiment_id", "variant_id", "request_id", "latency_ms", F.col("rank").cast("bigint").alias("rank"))


@register("retained_events", """
SELECT event_id FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 1000)""")
def retained_events(spark, sf):
    """W-03 retention: keep the newest 1000 events."""
    return W.retain_newest(table(spark, sf, "events"), "event_id", "ts", 1000).select("event_id")


@register("last_orders_per_status", """
SELECT o_orderstatus, o_orderkey, rank FROM (SELECT o_orderstatus, o_orderkey,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5""")
def last_orders_per_status(spark, sf):
    """W-04 last 5 per status."""
    r = W.newest_per_group(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate", 5, tie="o_orderkey")
    return r.select("o_orderstatus", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@register("in_flight", """
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS in_flight FROM events""")
def in_flight(spark, sf):
    """W-07 running +1 (click) / -1 (purchase) per user, split by day so a hot user spreads."""
    e = table(spark, sf, "events").withColumn(
        "delta", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0))
    from ..functions.time import epoch_micros
    day = F.floor(epoch_micros(e, "ts") / F.lit(86_400_000_000))
    r = running_sum_split(e, ["user_id"], ["ts", "event_id"], "delta", day, "in_flight")
    return r.select("event_id", "user_id", F.col("in_flight").cast("bigint").alias("in_flight"))


JOB_SQL = f"""
WITH e AS (SELECT user_id AS job_id, ts, event_id AS seq, event_type = 'error' AS failed,
                  CASE WHEN event_type = 'error' THEN NULL ELSE least(greatest(value / 3, 0.0), 100.0) END AS p FROM events),
k AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN p >= 100 THEN 'completed' END AS kind FROM e),
ft AS (SELECT job_id, arg_min(struct_pack(t := ts, s := seq, k := kind), (ts, seq)) FILTER (WHERE kind IS NOT NULL) AS f FROM k GROUP BY job_id),
j AS (SELECT k.*, ft.f FROM k JOIN ft USING (job_id)),
a AS (SELECT job_id,
        arg_max(p, (ts, seq)) FILTER (WHERE p IS NOT NULL) AS progress,
        arg_max(kind, (ts, seq)) FILTER (WHERE kind IS NOT NULL) AS last_terminal,
        bool_or(p > 0) AS any_started,
        min(ts) FILTER (WHERE p > 0 AND (f IS NULL OR (CASE WHEN f.k = 'failed' THEN (ts, seq) < (f.t, f.s) ELSE (ts, seq) <= (f.t, f.s) END))) AS started_at,
        max(ts) FILTER (WHERE kind = 'completed') AS completed_at, max(ts) FILTER (WHERE kind = 'failed') AS failed_at
      FROM j GROUP BY job_id)
SELECT job_id, coalesce(last_terminal, CASE WHEN coalesce(any_started, false) THEN 'running' END, 'pending') AS status,
  round(progress, 6) AS progress, {sql_ts('started_at')} AS started_at, {sql_ts('completed_at')} AS completed_at,
  {sql_ts('failed_at')} AS failed_at FROM a"""


@register("job_states", JOB_SQL)
def job_states(spark, sf):
    """W-08 job state per user-as-job: error = failure, value / 3 = progress."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
        (F.col("value") / 3).alias("progress"), (F.col("event_type") == "error").alias("failed"))
    s = W.job_states(e)
    return s.select("job_id", "status", F.round("progress", 6).alias("progress"), ts_str("started_at").alias("started_at"),
                    ts_str("completed_at").alias("completed_at"), ts_str("failed_at").alias("failed_at"))


@register("positional_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'validation' END AS split FROM documents""")
def positional_split(spark, sf):
    """W-09 90/10 split in document order."""
    return W.positional_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.9).select("doc_id", "split")


@register("random_split_sizes", """
SELECT split, count(*) AS n FROM (SELECT CASE WHEN rn < floor(c * 0.8) THEN 'train' WHEN rn < floor(c * 0.9) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT row_number() OVER () - 1 AS rn, count(*) OVER () AS c FROM documents)) GROUP BY split""")
def random_split_sizes(spark, sf):
    """W-10 seeded exact 80/10/10 split; sizes are checked by the oracle, membership by pytest."""
    s = W.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_sizes", """
SELECT fold, count(*) AS n FROM (SELECT CAST((row_number() OVER () - 1) % 5 AS INTEGER) AS fold FROM documents) GROUP BY fold""")
def kfold_sizes(spark, sf):
    """W-11 5-fold assignment; fold sizes checked by the oracle."""
    k = W.kfold(table(spark, sf, "documents").select("doc_id"), "doc_id", 5)
    return k.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("first_documents", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark, sf):
    """W-12 first-N cap (100) in document order."""
    return W.first_n(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100)


@register("source_label_ids", """
SELECT source AS output, CAST(row_number() OVER (ORDER BY min(doc_id), source) - 1 AS INTEGER) AS label_id FROM documents GROUP BY source""")
def source_label_ids(spark, sf):
    """W-13 dense label ids in first-seen order."""
    d = table(spark, sf, "documents").select(F.col("source").alias("output"), "doc_id")
    return W.label_ids(d, "output", seq="doc_id")


# Tier limits used by the quota query (tier, max_input_tokens, allowed models).
TIERS = [("free", 50, ["view", "click"]), ("basic", 80, ["view", "click", "signup"]),
         ("pro", 95, []), ("enterprise", 1000, [])]
TIER_NAMES = [t[0] for t in TIERS]


@register("quota_rejections", f"""
WITH r AS ({REQ_SQL}),
t AS (SELECT * FROM (VALUES ('free', 50, ['view', 'click']), ('basic', 80, ['view', 'click', 'signup']), ('pro', 95, []::VARCHAR[]), ('enterprise', 1000, []::VARCHAR[])) t(tier, max_input_tokens, allowed_models)),
u AS (SELECT user_id AS tenant_id, CASE WHEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.25 THEN 'suspended' ELSE 'active' END AS status,
      ['free', 'basic', 'pro', 'enterprise'][CAST((('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 4) AS INTEGER) + 1] AS tier
      FROM events GROUP BY user_id),
j AS (SELECT r.request_id, r.event_type AS model, r.tokens_in AS input_tokens, u.status, t.* FROM r JOIN u ON r.user_id = u.tenant_id JOIN t ON u.tier = t.tier)
SELECT request_id, CASE WHEN status <> 'active' THEN 'tenant_inactive' WHEN input_tokens > max_input_tokens THEN 'input_too_long'
  WHEN len(allowed_models) > 0 AND NOT list_contains(allowed_models, model) THEN 'model_not_allowed' END AS reject_reason FROM j""")
def quota_rejections(spark, sf):
    """J-10 quota check: tenant (user) x tier limits -> reject reason per request."""
    from ..functions.text import sha_bucket
    r = requests(spark, sf).withColumnRenamed("user_id", "tenant_id").withColumnRenamed("event_type", "model")
    tiers = spark.createDataFrame(TIERS, "tier string, max_input_tokens int, allowed_models array<string>")
    names = F.array(*[F.lit(n) for n in TIER_NAMES])
    # tenant status from the data: suspended when more than a quarter of its requests failed
    tenants = table(spark, sf, "events").groupBy(F.col("user_id").alias("tenant_id")).agg(
        F.avg((F.col("event_type") == "error").cast("double")).alias("_err")).select(
        "tenant_id", F.when(F.col("_err") > 0.25, "suspended").otherwise("active").alias("status"),
        F.try_element_at(names, (sha_bucket(F.col("tenant_id").cast("string"), 4) + 1).cast("int")).alias("tier"))
    q = J.quota_check(r, tenants, tiers, tokens_col="tokens_in")
    return q.select("request_id", "reject_reason")


# Webhook endpoints (id, subscribed event types, enabled).
ENDPOINTS = [("all", [], True), ("errors", ["error"], True), ("sales", ["purchase", "signup"], True),
             ("off", [], False)]


@register("webhook_fanout", """
WITH ep AS (SELECT * FROM (VALUES ('all', []::VARCHAR[], true), ('errors', ['error'], true), ('sales', ['purchase', 'signup'], true),
  ('off', []::VARCHAR[], false)) t(endpoint_id, events, enabled))
SELECT e.event_id, ep.endpoint_id FROM events e JOIN ep ON ep.enabled AND (len(ep.events) = 0 OR list_contains(ep.events, e.event_type))""")
def webhook_fanout(spark, sf):
    """J-11 event fan-out to subscribed, enabled endpoints."""
    ep = spark.createDataFrame(ENDPOINTS, "endpoint_id string, events array<string>, enabled boolean")
    return J.event_fanout(table(spark, sf, "events"), ep).select("event_id", "endpoint_id")


@register("job_summary", f"""
WITH j AS ({JOB_SQL})
SELECT count(*) FILTER (WHERE status = 'running') AS active, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM j""")
def job_summary(spark, sf):
    """A-08 job summary over the W-08 job states."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
        (F.col("value") / 3).alias("progress"), (F.col("event_type") == "error").alias("failed"))
    return A.job_summary(W.job_states(e))


DAYS_SQL = """
WITH d AS (SELECT event_type AS name, CAST(day(ts) AS BIGINT) AS day, avg(value) AS loss, count(*)::DOUBLE AS seen, count(*) FILTER (WHERE value > 100)::DOUBLE AS large,
  count(*) % 4 AS batch, max(user_id) % 3 AS warm FROM events GROUP BY 1, 2),
p AS (SELECT name, '1.' || CAST(day AS VARCHAR) || '.0' AS v1, '1.' || CAST(lead(day) OVER w AS VARCHAR) || '.0' AS v2, loss, seen, large, batch, warm,
  lead(loss) OVER w AS loss2, lead(seen) OVER w AS seen2, lead(large) OVER w AS large2, lead(batch) OVER w AS batch2, lead(warm) OVER w AS warm2
  FROM d WINDOW w AS (PARTITION BY name ORDER BY day) QUALIFY lead(day) OVER w IS NOT NULL)"""


def _daily_versions(spark, sf):
    """Each event type is a model, each day of it a version with metrics and nested settings."""
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), F.dayofmonth("ts").alias("day")).agg(
        F.avg("value").alias("loss"), F.count(F.lit(1)).alias("seen"), F.count_if(F.col("value") > 100).alias("large"), (F.max("user_id") % 3).alias("warm"))
    few = F.col("large") > 0  # a metric that some versions lack
    metrics = F.map_filter(F.create_map(F.lit("val_loss"), F.col("loss"), F.lit("seen"), F.col("seen").cast("double"), F.lit("large"), F.when(few, F.col("large").cast("double"))),
                           lambda k, v: v.isNotNull())
    config = F.to_json(F.struct((F.col("seen") % 4).alias("batch"), F.struct(F.when(F.col("warm") > 0, F.col("warm")).alias("warm"), F.lit("adam").alias("name")).alias("optim")))
    return d.select("name", F.format_string("1.%d.0", "day").alias("version"), metrics.alias("metrics"), F.parse_json(config).alias("config"))


@register("version_metric_changes", f"""{DAYS_SQL},
m AS (SELECT name, v1, v2, 'val_loss' AS metric, loss AS old, loss2 AS new FROM p UNION ALL SELECT name, v1, v2, 'seen', seen, seen2 FROM p
      UNION ALL SELECT name, v1, v2, 'large', large, large2 FROM p WHERE large > 0 AND large2 > 0)
SELECT name, v1, v2, metric, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS diff,
  CASE WHEN metric = 'val_loss' THEN new - old < 0 ELSE new - old > 0 END AS improved FROM m""")
def version_metric_changes(spark, sf):
    """J-12 metrics: every version of every model against the next, in SemVer order."""
    from ..operators.versions import version_changes
    m, _ = version_changes(_daily_versions(spark, sf))
    return m.select("name", "v1", "v2", "metric", *[F.round(c, 6).alias(c) for c in ("old", "new", "diff")], "improved")


@register("version_config_changes", f"""{DAYS_SQL},
c AS (SELECT name, v1, v2, 'batch' AS path, CAST(batch AS VARCHAR) AS old, CAST(batch2 AS VARCHAR) AS new FROM p
      UNION ALL SELECT name, v1, v2, 'optim.warm', CASE WHEN warm > 0 THEN CAST(warm AS VARCHAR) END, CASE WHEN warm2 > 0 THEN CAST(warm2 AS VARCHAR) END FROM p)
SELECT * FROM c WHERE old IS DISTINCT FROM new""")
def version_config_changes(spark, sf):
    """J-12 settings: nested keys that differ between a version and the next, or are in one alone."""
    from ..operators.versions import version_changes
    return version_changes(_daily_versions(spark, sf))[1]
