import datetime as dt
import math

from pyspark.sql import functions as F

from corpuskit.operators import experiments as X
from corpuskit.operators import monitoring as MON
from corpuskit.operators import ranking as W

T0 = dt.datetime(2024, 1, 1)


def _variants(spark):
    return spark.createDataFrame(
        [("e", "e/c", "c", True, 50.0, 0), ("e", "e/t", "t", False, 50.0, 1)],
        "experiment_id string, variant_id string, name string, is_control boolean, percentage double, variant_seq int"
    ).withColumn("seq", F.col("variant_seq"))


def test_p_value_matches_python(spark):
    rows = [("e", "e/c", T0, True, float(x), 1, 1) for x in (10, 12, 11, 13, 9)] + \
           [("e", "e/t", T0, True, float(x), 1, 1) for x in (20, 22, 21, 19, 18)]
    req = spark.createDataFrame(rows, "experiment_id string, variant_id string, ts timestamp, success boolean, "
                                      "latency_ms double, tokens_in long, tokens_out long")
    c = X.compare_variants(X.metric_moments(req, "latency_ms"), _variants(spark), "latency_ms").first()
    m1, m2, v1, v2 = 11.0, 20.0, 2.5, 2.5
    z = (m2 - m1) / math.sqrt(v2 / 5 + v1 / 5)
    p = 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))
    assert abs(c.z_score - z) < 1e-9 and abs(c.p_value - p) < 1e-12
    assert c.is_significant and c.winner == "e/c"  # latency: lower is better, control wins


def test_degenerate_variance_flag_and_guard(spark):
    rows = [("e", "e/c", T0, True, 5.0, 0, 0)] * 3 + [("e", "e/t", T0, True, 7.0, 0, 0)] * 3
    req = spark.createDataFrame(rows, "experiment_id string, variant_id string, ts timestamp, success boolean, "
                                      "latency_ms double, tokens_in long, tokens_out long")
    c = X.compare_variants(X.metric_moments(req, "latency_ms"), _variants(spark), "latency_ms").first()
    assert c.z_score == 0.0 and c.p_value == 1.0 and c.degenerate_variance
    one = req.limit(1)
    g = X.compare_variants(X.metric_moments(one, "latency_ms"), _variants(spark), "latency_ms").first()
    assert g.p_value == 1.0 and not g.sufficient_n


def test_allocation_violations(spark):
    v = spark.createDataFrame([("a", "a/1", True), ("a", "a/2", True), ("b", "b/1", True)],
                              "experiment_id string, variant_id string, is_control boolean")
    al = spark.createDataFrame([("a", "a/1", 60.0), ("a", "a/2", 30.0), ("b", "b/1", 100.0), ("b", "b/9", 0.0)],
                               "experiment_id string, variant_id string, percentage double")
    got = sorted(tuple(r) for r in X.allocation_violations(v, al).collect())
    assert got == [("a", "not_exactly_one_control"), ("a", "percentages_do_not_sum_to_100"),
                   ("b", "allocation_for_unknown_variant")]


def test_assignment_fallback_to_last_variant(spark):
    al = spark.createDataFrame([("e", "e/a", 0.0, 0, 0), ("e", "e/b", 0.0, 1, 1)],
                               "experiment_id string, variant_id string, percentage double, seq int, variant_seq int")
    r = spark.createDataFrame([("e", 1), ("e", 2)], "experiment_id string, user_id int")
    assert {x.variant_id for x in X.assign_variants(r, al).collect()} == {"e/b"}


def test_histogram_and_quantile(spark):
    pts = spark.createDataFrame([(float(v),) for v in (0.1, 0.2, 0.3, 0.4)], "value double")
    h = MON.histogram(pts, (0.25, 0.5))
    got = sorted((r.le, r.cum) for r in h.collect())
    assert got == [(0.25, 2), (0.5, 4), (float("inf"), 4)]
    q = MON.bucket_quantile(h, 0.5).first().value
    assert abs(q - 0.25) < 1e-12  # rank 2 reaches the first bucket's end


def test_job_states(spark):
    ev = spark.createDataFrame([
        (1, T0, 1, 10.0, False), (1, T0 + dt.timedelta(1), 2, 150.0, False),
        (2, T0, 1, 0.0, True), (2, T0 + dt.timedelta(1), 2, 50.0, False),
        (3, T0, 1, 0.0, False)], "job_id int, ts timestamp, seq int, progress double, failed boolean")
    s = {r.job_id: r for r in W.job_states(ev).collect()}
    assert s[1].status == "completed" and s[1].progress == 100.0 and s[1].started_at == T0
    assert s[2].status == "failed" and s[2].started_at is None
    assert s[3].status == "pending"


def test_random_split_exact_and_disjoint(spark):
    d = spark.range(0, 1003).withColumnRenamed("id", "k")
    s = W.random_split(d, "k")
    sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 802, "validation": 100, "test": 101}
    assert s.select("k").distinct().count() == 1003
    again = {r.k: r.split for r in W.random_split(d, "k").collect()}
    assert again == {r.k: r.split for r in s.collect()}
    folds = W.kfold(d, "k", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [200, 200, 201, 201, 201]


def test_unknown_metric_guard_and_interpretation(spark):
    rows = [("e", "e/c", T0, True, float(x), 1, 1) for x in (10, 12, 11, 13, 9)] + \
           [("e", "e/t", T0, True, float(x), 1, 1) for x in (20, 22, 21, 19, 18)]
    req = spark.createDataFrame(rows, "experiment_id string, variant_id string, ts timestamp, success boolean, "
                                      "latency_ms double, tokens_in long, tokens_out long")
    c = X.compare_variants(X.metric_moments(req, "latency_ms"), _variants(spark), "latency_ms").first()
    assert c.interpretation.startswith("Treatment shows 81.8% degradation in latency_ms (p=0.0000")
    u = X.compare_variants(X.metric_moments(req, "latency_ms"), _variants(spark), "bogus").first()
    assert (u.p_value, u.is_significant, u.interpretation) == (1.0, False, "Unknown metric: bogus")


def test_random_split_ceil_last(spark):
    d = spark.range(0, 101).withColumnRenamed("id", "k")
    sizes = {r.split: r["count"] for r in W.random_split(d, "k", (0.9, 0.1), ("train", "test"), rounding="ceil_last")
             .groupBy("split").count().collect()}
    assert sizes == {"train": 90, "test": 11}
