"""A/B experiment analytics over request rows (J-08, A-09 ... A-13).

Requests: ``experiment_id, variant_id, user_id, ts, success, latency_ms, tokens_in,
tokens_out``. Experiments / variants / allocations are configuration tables (one row per
variant); they are joined without hints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import inverse_normal_cdf, normal_cdf
from ..functions.text import sha_bucket


def assign_variants(requests: DataFrame, allocations: DataFrame, user_col: str = "user_id",
                    experiment_col: str = "experiment_id") -> DataFrame:
    """J-08: hash bucket of ``"user:experiment"`` (first 4 bytes of sha256, mod 10000, / 100)
    -> first allocation whose cumulative percentage exceeds it; else the experiment's last
    variant. ``allocations``: experiment_id, variant_id, percentage, seq (allocation order),
    variant_seq (variant order).

    Equi-join on the experiment with the bucket range as a further condition; no hint, AQE sizes
    the allocation table.
    """
    w = Window.partitionBy("experiment_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    alloc = allocations.withColumn("_hi", F.sum("percentage").over(w)).withColumn("_lo", F.col("_hi") - F.col("percentage"))
    alloc = alloc.select(F.col("experiment_id").alias("_ae"), F.col("variant_id").alias("_av"), "_lo", "_hi")
    last = allocations.groupBy(F.col("experiment_id").alias("_fe")).agg(
        F.max_by("variant_id", "variant_seq").alias("_fallback"))
    r = requests.withColumn(
        "bucket", sha_bucket(F.concat_ws(":", F.col(user_col).cast("string"), F.col(experiment_col))) / 100.0)
    cond = (F.col(experiment_col) == F.col("_ae")) & (F.col("bucket") >= F.col("_lo")) & (F.col("bucket") < F.col("_hi"))
    j = r.join(alloc, cond, "left")
    j = j.join(last, F.col(experiment_col) == F.col("_fe"), "left")
    return j.withColumn("variant_id", F.coalesce("_av", "_fallback")).drop("_ae", "_av", "_lo", "_hi", "_fe", "_fallback")


def variant_rollup(requests: DataFrame, keys=("experiment_id", "variant_id"), rounded: bool = True) -> DataFrame:
    """A-09: one aggregation pass per (experiment, variant)."""
    a = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.coalesce(F.min("latency_ms"), F.lit(0.0)).alias("min_latency_ms"),
        F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency_ms"),
        F.sum("tokens_in").alias("total_tokens_in"),
        F.sum("tokens_out").alias("total_tokens_out"),
        F.max("ts").alias("last_updated"))
    n = F.col("request_count")
    r = (lambda c, k: F.round(c, k)) if rounded else (lambda c, k: c)
    return a.select(
        *keys, "request_count", "success_count", "error_count", "total_latency_ms",
        r(F.when(n > 0, F.col("total_latency_ms") / n).otherwise(F.lit(0.0)), 2).alias("avg_latency_ms"),
        "min_latency_ms", "max_latency_ms",
        r(F.when(n > 0, F.col("success_count") / n).otherwise(F.lit(0.0)), 4).alias("success_rate"),
        "total_tokens_in", "total_tokens_out",
        r(F.when(n > 0, F.col("total_tokens_in") / n).otherwise(F.lit(0.0)), 2).alias("avg_tokens_in"),
        r(F.when(n > 0, F.col("total_tokens_out") / n).otherwise(F.lit(0.0)), 2).alias("avg_tokens_out"),
        r(F.when(F.col("total_latency_ms") > 0, F.col("total_tokens_out") * 1000.0 / F.col("total_latency_ms"))
          .otherwise(F.lit(0.0)), 2).alias("tokens_per_second"),
        "last_updated")


def experiment_totals(rollup: DataFrame) -> DataFrame:
    """A-09 per experiment: total requests and last update."""
    return rollup.groupBy("experiment_id").agg(F.sum("request_count").alias("total_requests"),
                                               F.max("last_updated").alias("last_updated"))


# Metric direction (lower is better?) for the supported primary metrics.
LOWER_IS_BETTER = {"latency_ms": True, "success_rate": False, "tokens_per_second": False}


def metric_moments(requests: DataFrame, metric: str, keys=("experiment_id", "variant_id")) -> DataFrame:
    """Per variant n, mean and sample variance of the metric under test (D5)."""
    if metric == "latency_ms":
        x = F.col("latency_ms")
    elif metric == "success_rate":
        x = F.col("success").cast("double")
    elif metric == "tokens_per_second":
        x = None
    else:
        raise ValueError(f"Unknown metric: {metric}")
    if x is None:
        a = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_out").alias("_o"),
                                        F.sum("latency_ms").alias("_l"))
        mean = F.when(F.col("_l") > 0, F.col("_o") * 1000.0 / F.col("_l")).otherwise(F.lit(0.0))
        return a.select(*keys, "n", mean.alias("mean")).withColumn(
            "var", F.when(F.col("mean") > 0, F.pow(F.col("mean") * 0.3, 2)).otherwise(F.lit(1.0)))
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                                       F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"))


def compare_variants(moments: DataFrame, variants: DataFrame, metric: str = "latency_ms",
                     confidence_level: float = 0.95, with_p: bool = True) -> DataFrame:
    """A-10: every treatment against its experiment's control.

    ``variants``: experiment_id, variant_id, is_control. Output per treatment: n, means, z,
    Cohen's d with CI, and (``with_p``) two-tailed p, significance, winner and interpretation.
    n < 2 on either side gives p = 1, d = 0 (guard); zero pooled variance gives z = 0 and sets
    ``degenerate_variance`` (D4); an unknown metric gives non-significant rows saying so.
    """
    if metric not in LOWER_IS_BETTER:
        # unknown-metric guard: every comparison is reported as not significant, with the reason
        ctl = variants.filter("is_control").select("experiment_id", F.col("variant_id").alias("control_id"))
        trt = variants.filter(~F.col("is_control")).select("experiment_id", "variant_id")
        return trt.join(ctl, "experiment_id").select(
            "experiment_id", "variant_id", "control_id", F.lit(0.0).alias("z_score"), F.lit(0.0).alias("effect_size"),
            F.lit(0.0).alias("ci_lower"), F.lit(0.0).alias("ci_upper"), F.lit(False).alias("degenerate_variance"),
            F.lit(False).alias("sufficient_n"), F.lit(1.0).alias("p_value"), F.lit(False).alias("is_significant"),
            F.lit(None).cast("string").alias("winner"), F.lit(f"Unknown metric: {metric}").alias("interpretation"),
            F.lit(metric).alias("metric"))
    v = variants.join(moments, ["experiment_id", "variant_id"], "left").na.fill({"n": 0, "mean": 0.0, "var": 0.0})
    ctl = v.filter("is_control").select("experiment_id", F.col("variant_id").alias("control_id"),
                                        F.col("n").alias("n1"), F.col("mean").alias("mean1"), F.col("var").alias("var1"))
    trt = v.filter(~F.col("is_control")).select("experiment_id", "variant_id", F.col("n").alias("n2"),
                                                F.col("mean").alias("mean2"), F.col("var").alias("var2"))
    d = trt.join(ctl, "experiment_id")
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "mean1", "mean2", "var1", "var2"))
    ok = (n1 >= 2) & (n2 >= 2)
    se = F.sqrt(v2 / n2 + v1 / n1)
    z = F.when(ok & (se > 0), (m2 - m1) / se).otherwise(F.lit(0.0))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    eff = F.when(ok & (pooled > 0), (m2 - m1) / pooled).otherwise(F.lit(0.0))
    d = d.withColumn("z_score", z).withColumn("effect_size", eff)
    se_d = F.sqrt((n1 + n2) / (n1 * n2) + F.col("effect_size") ** 2 / (2 * (n1 + n2)))
    zc = inverse_normal_cdf(F.lit((1 + confidence_level) / 2))
    d = d.withColumn("ci_lower", F.when(ok, F.col("effect_size") - zc * se_d).otherwise(F.lit(0.0))) \
        .withColumn("ci_upper", F.when(ok, F.col("effect_size") + zc * se_d).otherwise(F.lit(0.0))) \
        .withColumn("degenerate_variance", ok & ~(se > 0) & (m1 != m2)) \
        .withColumn("sufficient_n", ok)
    if with_p:
        alpha = 1 - confidence_level
        p = F.when(ok, 2 * (1 - normal_cdf(F.abs(F.col("z_score"))))).otherwise(F.lit(1.0))
        d = d.withColumn("p_value", p).withColumn("is_significant", F.col("p_value") < alpha)
        better = (F.col("effect_size") < 0) if LOWER_IS_BETTER[metric] else (F.col("effect_size") > 0)
        d = d.withColumn("winner", F.when(F.col("is_significant"),
                                          F.when(better, F.col("variant_id")).otherwise(F.col("control_id"))))
        pct = F.when(m1 != 0, F.abs((m2 - m1) / m1 * 100)).otherwise(F.lit(0.0))
        direction = F.when(F.col("winner") == F.col("variant_id"), F.lit("improvement")).otherwise(F.lit("degradation"))
        text = (F.when(~ok, F.lit("Insufficient data for analysis"))
                .when(~F.col("is_significant"),
                      F.format_string("No statistically significant difference detected (p=%.4f)", F.col("p_value")))
                .otherwise(F.format_string("Treatment shows %.1f%% %s in %s (p=%.4f, effect size d=%.3f)", pct, direction,
                                           F.lit(metric), F.col("p_value"), F.col("effect_size"))))
        d = d.withColumn("interpretation", text)
    return d.withColumn("metric", F.lit(metric))


def analyze_experiment(requests: DataFrame, variants: DataFrame, experiments: DataFrame,
                       metric: str = "latency_ms") -> DataFrame:
    """A-11: per experiment sample sizes (variants without requests count 0, D6),
    sufficiency against ``min_sample_size``, and one of four recommendations."""
    from ..session import cut_lineage
    # one aggregation (variants x moments: a few rows), materialised once; sizes and tests read it
    moments = cut_lineage(metric_moments(requests, metric))
    counts = variants.join(moments.select("experiment_id", "variant_id", "n"),
                           ["experiment_id", "variant_id"], "left").na.fill({"n": 0})
    sizes = counts.groupBy("experiment_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant_id", "n")))).alias("sample_sizes"),
        F.min("n").alias("min_n"))
    conf = experiments.select("experiment_id", "min_sample_size", "confidence_level")
    cmp_ = compare_variants(moments, variants, metric, with_p=True)
    win = cmp_.filter(F.col("is_significant") & (F.col("winner") == F.col("variant_id")))
    first_win = win.join(variants.select("experiment_id", "variant_id", "variant_seq", "name"),
                         ["experiment_id", "variant_id"]).groupBy("experiment_id").agg(
        F.min_by("name", "variant_seq").alias("winner_name"), F.min_by("interpretation", "variant_seq").alias("_why"))
    any_sig = cmp_.groupBy("experiment_id").agg(F.max(F.col("is_significant").cast("int")).alias("any_sig"))
    d = sizes.join(conf, "experiment_id").join(first_win, "experiment_id", "left").join(any_sig, "experiment_id", "left")
    d = d.withColumn("sufficient_sample_size", F.col("min_n") >= F.col("min_sample_size"))
    rec = (F.when(~F.col("sufficient_sample_size"), F.lit("continue"))
           .when(F.col("winner_name").isNotNull(), F.lit("adopt"))
           .when(F.coalesce(F.col("any_sig"), F.lit(0)) == 1, F.lit("control_best"))
           .otherwise(F.lit("no_difference")))
    # Recommendation messages.
    text = (F.when(~F.col("sufficient_sample_size"), F.format_string(
                "Continue collecting data. Need at least %d samples per variant. Current: %d", "min_sample_size", "min_n"))
            .when(F.col("winner_name").isNotNull(), F.format_string(
                "Consider adopting '%s' as the new baseline. It shows statistically significant improvement. %s",
                "winner_name", "_why"))
            .when(F.coalesce(F.col("any_sig"), F.lit(0)) == 1, F.lit(
                "Control variant performs best. Consider stopping the experiment or trying different configurations."))
            .otherwise(F.lit("No significant differences detected. Consider extending the experiment or increasing "
                             "sample size for more conclusive results.")))
    return d.withColumn("recommendation", rec).withColumn("recommendation_text", text).select(
        "experiment_id", "sample_sizes", "min_n", "min_sample_size", "sufficient_sample_size",
        "winner_name", "recommendation", "recommendation_text")


def required_sample_size(df: DataFrame, baseline_col: str = "baseline_rate", mde: float = 0.05,
                         alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """A-12: required n per variant, ``ceil(2 p(1-p) ((z_a + z_b) / effect)^2)``; NULL (inf)
    when the effect is 0."""
    b = F.col(baseline_col)
    t = b * (1 + mde)
    pp = (b + t) / 2
    za, zb = inverse_normal_cdf(F.lit(1 - alpha / 2)), inverse_normal_cdf(F.lit(power))
    eff = F.abs(t - b)
    n = 2 * pp * (1 - pp) * F.pow((za + zb) / eff, 2)
    return df.withColumn("required_n", F.when(eff == 0, F.lit(None).cast("bigint")).otherwise(F.ceil(n).cast("bigint")))


def allocation_violations(variants: DataFrame, allocations: DataFrame) -> DataFrame:
    """A-13: per experiment, percentages summing to 100 +- 0.1, every variant allocated and
    every allocation a known variant, exactly one control. One row per violation."""
    s = allocations.groupBy("experiment_id").agg(F.sum("percentage").alias("total_pct"))
    cov = variants.select("experiment_id", "variant_id", F.lit(1).alias("_v")).join(
        allocations.select("experiment_id", "variant_id", F.lit(1).alias("_a")), ["experiment_id", "variant_id"], "full_outer")
    covg = cov.groupBy("experiment_id").agg(F.count_if(F.col("_a").isNull()).alias("unallocated"),
                                            F.count_if(F.col("_v").isNull()).alias("unknown"))
    ctl = variants.groupBy("experiment_id").agg(F.count_if("is_control").alias("n_control"))
    d = ctl.join(s, "experiment_id", "full_outer").join(covg, "experiment_id", "full_outer").na.fill(0)
    issues = F.array_compact(F.array(
        F.when(F.abs(F.col("total_pct") - 100) > 0.1, F.lit("percentages_do_not_sum_to_100")),
        F.when(F.col("unallocated") > 0, F.lit("variant_without_allocation")),
        F.when(F.col("unknown") > 0, F.lit("allocation_for_unknown_variant")),
        F.when(F.col("n_control") != 1, F.lit("not_exactly_one_control"))))
    return d.select("experiment_id", F.explode(issues).alias("violation"))
