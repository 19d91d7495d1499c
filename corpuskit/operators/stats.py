"""Aggregations over samples, jobs, requests and evaluations (A-01 ... A-08, A-18 ... A-28).

Everything is one ``groupBy().agg`` pass (partial aggregation before the shuffle); no
operator collects a group. Top-k reports use ``orderBy().limit`` (TakeOrderedAndProject:
each task keeps k rows, the driver merges k x tasks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip, word_count


def dataset_summary(samples: DataFrame) -> DataFrame:
    """A-01: n_records and mean whitespace word counts; zeros when empty (one row)."""
    return samples.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.avg(word_count("input")), F.lit(0.0)).alias("avg_input_len"),
        F.coalesce(F.avg(word_count("output")), F.lit(0.0)).alias("avg_output_len"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """A-02: total, distinct outputs, mean/min/max input length, mean output length (chars)."""
    return samples.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.countDistinct("output").alias("unique_outputs"),
        F.avg(F.length("input")).alias("avg_input_length"),
        F.avg(F.length("output")).alias("avg_output_length"),
        F.min(F.length("input")).alias("min_input_length"),
        F.max(F.length("input")).alias("max_input_length"))


def output_distribution(samples: DataFrame, top: int = 15) -> DataFrame:
    """A-02: most frequent outputs (count desc, then output asc), top ``top``."""
    return (samples.groupBy("output").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("output")).limit(top))


def validation_report_hands_on(lines: DataFrame, line_col: str = "line", num_col: str = "line_num") -> tuple[DataFrame, DataFrame]:
    """A-03, second profile: every line is parsed (a blank line is invalid JSON); a record can
    report missing input and missing output together; a missing or blank field is also an
    empty one; output shorter than 10 chars (missing = 0). No duplicate check. Returns
    (issues, totals)."""
    from ..functions.jsonl import parse_json_strict
    v = parse_json_strict(F.col(line_col))
    d = lines.select(F.col(num_col).alias("line_num"), v.alias("_v"))
    inp = F.try_variant_get("_v", "$.input", "string")
    out = F.try_variant_get("_v", "$.output", "string")
    d = d.withColumn("input", inp).withColumn("output", out)
    ok = F.col("_v").isNotNull()
    flags = F.array_compact(F.array(
        F.when(~ok, F.lit("invalid_json")),
        F.when(ok & F.col("input").isNull(), F.lit("missing_input")),
        F.when(ok & F.col("output").isNull(), F.lit("missing_output")),
        F.when(ok & (py_strip(F.coalesce("input", F.lit(""))) == ""), F.lit("empty_input")),
        F.when(ok & (py_strip(F.coalesce("output", F.lit(""))) == ""), F.lit("empty_output")),
        F.when(ok & (F.length(F.coalesce("output", F.lit(""))) < 10), F.lit("short_output"))))
    issues = d.select("line_num", F.explode(flags).alias("issue"))
    totals = d.agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(ok).alias("examples"),
                   F.sum(F.size(flags)).alias("issues"))
    return issues, totals


def validation_report(lines: DataFrame, line_col: str = "line", num_col: str = "line_num") -> tuple[DataFrame, DataFrame]:
    """A-03: JSONL validation. Returns (issues, stats).

    Per line: blank lines are skipped; invalid JSON; missing input / output; then on valid
    records empty input, empty output and duplicate input (an input seen on an earlier line).
    ``stats``: total_lines, valid_examples, empty_inputs, empty_outputs, duplicates, invalid_json,
    missing_field, short_outputs (< 10 chars) and mean lengths of valid records.
    """
    from ..functions.jsonl import parse_json_strict
    v = parse_json_strict(F.col(line_col))
    d = lines.select(F.col(num_col).alias("line_num"), F.col(line_col).alias("line"),
                     v.alias("_v"))
    d = d.withColumn("blank", py_strip(F.coalesce("line", F.lit(""))) == "")
    inp = F.try_variant_get("_v", "$.input", "string")
    out = F.try_variant_get("_v", "$.output", "string")
    d = d.withColumn("input", inp).withColumn("output", out)
    d = d.withColumn("kind", F.when(F.col("blank"), F.lit("blank"))
                     .when(F.col("_v").isNull(), F.lit("invalid_json"))
                     .when(F.col("input").isNull(), F.lit("missing_input"))
                     .when(F.col("output").isNull(), F.lit("missing_output"))
                     .otherwise(F.lit("valid")))
    valid = d.filter(F.col("kind") == "valid")
    first = valid.groupBy("input").agg(F.min("line_num").alias("_first"))
    valid = valid.join(first, "input").withColumn("dup", F.col("line_num") > F.col("_first"))
    issue_lists = F.array_compact(F.array(
        F.when(py_strip("input") == "", F.lit("empty_input")),
        F.when(py_strip("output") == "", F.lit("empty_output")),
        F.when(F.col("dup"), F.lit("duplicate_input")),
        F.when(F.length("output") < 10, F.lit("short_output"))))
    v_issues = valid.select("line_num", F.explode(issue_lists).alias("issue"))
    bad = d.filter(F.col("kind").isin("invalid_json", "missing_input", "missing_output")) \
        .select("line_num", F.col("kind").alias("issue"))
    issues = v_issues.unionByName(bad)
    per_line = d.agg(F.count(F.lit(1)).alias("total_lines"),
                     F.count_if(F.col("kind") == "invalid_json").alias("invalid_json"),
                     F.count_if(F.col("kind").isin("missing_input", "missing_output")).alias("missing_field"))
    per_valid = valid.agg(
        F.count(F.lit(1)).alias("valid_examples"),
        F.count_if(py_strip("input") == "").alias("empty_inputs"),
        F.count_if(py_strip("output") == "").alias("empty_outputs"),
        F.count_if("dup").alias("duplicates"),
        F.count_if(F.length("output") < 10).alias("short_outputs"),
        F.coalesce(F.avg(F.length("input")), F.lit(0.0)).alias("avg_input_length"),
        F.coalesce(F.avg(F.length("output")), F.lit(0.0)).alias("avg_output_length"))
    from .relate import with_one_row
    return issues, with_one_row(per_line, per_valid)


def quality_checks(samples: DataFrame) -> DataFrame:
    """A-04: short input/output (< 3 chars), very long output (> 2000), duplicate inputs."""
    base = samples.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.length(F.coalesce("input", F.lit(""))) < 3).alias("input_too_short"),
        F.count_if(F.length(F.coalesce("output", F.lit(""))) < 3).alias("output_too_short"),
        F.count_if(F.length("output") > 2000).alias("output_too_long"),
        F.countDistinct("input").alias("_distinct"))
    return base.withColumn("duplicate_inputs", F.col("total") - F.col("_distinct")).drop("_distinct")


def class_balance(df: DataFrame, label_col: str = "output") -> DataFrame:
    """A-05: count and share per class, with the dominant share on every row."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over a one-row-per-class table: small by construction
    return (c.withColumn("share", F.col("n") / F.sum("n").over(w))
            .withColumn("dominant_share", F.max("share").over(w)))


def counts_by(df: DataFrame, keys: Sequence[str] | str, error_col: str | None = None) -> DataFrame:
    """A-06: counts per source / folder / file; with ``error_col``, failures and the first
    error text (alphabetically) are reported too."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = [F.count(F.lit(1)).alias("n")]
    if error_col:
        aggs += [F.count_if(F.col(error_col).isNotNull()).alias("n_failed"),
                 F.min(error_col).alias("first_error")]
    return df.groupBy(*keys).agg(*aggs)


def status_totals(df: DataFrame, status_col: str, statuses: Sequence[str],
                  sum_col: str | None = None) -> DataFrame:
    """A-07: one-pass conditional counts per status value, total, and an optional sum."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(status_col) == s).alias(f"n_{s.lower()}") for s in statuses]
    if sum_col:
        aggs.append(F.sum(sum_col).alias(f"sum_{sum_col}"))
    return df.agg(*aggs)


def status_counts(df: DataFrame, status_col: str) -> DataFrame:
    """A-08: count per status."""
    return df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))


def job_summary(jobs: DataFrame, status_col: str = "status") -> DataFrame:
    """A-08 job summary: active (running), completed, failed and total jobs in one pass."""
    st = F.col(status_col)
    return jobs.agg(F.count_if(st == "running").alias("active"), F.count_if(st == "completed").alias("completed"),
                    F.count_if(st == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


def tenant_usage(requests: DataFrame, tenant_col: str = "tenant_id", ts_col: str = "ts") -> DataFrame:
    """A-18: requests, tokens in/out and last request time per tenant."""
    return requests.groupBy(tenant_col).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum("tokens_in").alias("total_tokens_in"),
        F.sum("tokens_out").alias("total_tokens_out"),
        F.max(ts_col).alias("last_request"))


def confidence_evaluation(df: DataFrame, pred: str = "prediction", ref: str = "output",
                          conf: str = "confidence") -> DataFrame:
    """A-19: accuracy, mean confidence of right and of wrong answers, error count."""
    right = F.col(pred) == F.col(ref)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(right).alias("correct"),
        F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"),
        F.avg(F.when(right, F.col(conf))).alias("avg_conf_correct"),
        F.avg(F.when(~right, F.col(conf))).alias("avg_conf_wrong"),
        F.count_if(~right).alias("errors"))


# Error-type length ratios (A-20) and loss verdict bands (A-23).
SHORT_RATIO, LONG_RATIO = 0.5, 1.5
LOSS_GOOD, LOSS_OK = 0.5, 1.0


def error_type(pred, ref):
    """A-20 error class of one wrong prediction."""
    p, r = F.col(pred), F.col(ref)
    return (F.when(F.length(p) < F.length(r) * SHORT_RATIO, F.lit("too_short"))
            .when(F.length(p) > F.length(r) * LONG_RATIO, F.lit("too_long"))
            .when(F.lower(p) == F.lower(r), F.lit("case_mismatch"))
            .otherwise(F.lit("content_error")))


def error_analysis(df: DataFrame, pred: str = "prediction", ref: str = "output",
                   conf: str | None = "confidence", top: int = 5) -> dict[str, DataFrame]:
    """A-20: errors grouped by expected prefix (30 chars, top ``top``), low/high confidence
    split (< .5), and error-type distribution with percent of all errors."""
    errors = df.filter(~F.col(pred).eqNullSafe(F.col(ref)))
    by_expected = (errors.groupBy(F.substring(ref, 1, 30).alias("expected_prefix"))
                   .agg(F.count(F.lit(1)).alias("n_errors"))
                   .orderBy(F.desc("n_errors"), "expected_prefix").limit(top))
    out = {"by_expected": by_expected}
    if conf:
        out["confidence"] = errors.agg(F.count_if(F.col(conf) < 0.5).alias("low_conf_errors"),
                                       F.count_if(F.col(conf) >= 0.5).alias("high_conf_errors"))
    types = errors.groupBy(error_type(pred, ref).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
    out["types"] = types.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))
    return out


def keyword_coverage(df: DataFrame, response: str = "response", keywords: str = "expected_keywords") -> DataFrame:
    """A-21: keywords found (case-insensitive substring), missing, coverage, pass (>= .5)."""
    r = F.lower(F.coalesce(F.col(response), F.lit("")))
    kw = F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    found = F.filter(kw, lambda k: F.contains(r, F.lower(k)))
    missing = F.filter(kw, lambda k: ~F.contains(r, F.lower(k)))
    cov = F.when(F.size(kw) > 0, F.size(found) / F.size(kw)).otherwise(F.lit(0.0))
    return df.select("*", found.alias("found_keywords"), missing.alias("missing_keywords"),
                     cov.alias("coverage"), F.length(F.coalesce(F.col(response), F.lit(""))).alias("response_length"),
                     (cov >= 0.5).alias("passed"))


def keyword_pass_rate(scored: DataFrame) -> DataFrame:
    """A-21 roll-up: tests, passed, pass rate, mean coverage."""
    return scored.agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("passed"),
                      F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
                      F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("avg_coverage"))


def char_accuracy(df: DataFrame, pred: str = "prediction", ref: str = "output") -> DataFrame:
    """A-22: exact-match %, position-wise character accuracy % over the shorter length,
    mean lengths and their ratio."""
    p, r = F.coalesce(F.col(pred), F.lit("")), F.coalesce(F.col(ref), F.lit(""))
    n = F.least(F.length(p), F.length(r))
    same = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n),
                                         lambda i: F.substring(p, i, 1) == F.substring(r, i, 1)))).otherwise(F.lit(0))
    per = df.select((p == r).alias("em"), same.alias("c"), n.alias("t"), F.length(p).alias("lp"), F.length(r).alias("lr"))
    a = per.agg(F.avg(F.col("em").cast("double")).alias("_em"), F.sum("c").alias("_c"), F.sum("t").alias("_t"),
                F.avg("lp").alias("avg_pred_len"), F.avg("lr").alias("avg_ref_len"))
    return a.select((F.col("_em") * 100).alias("exact_match"),
                    F.when(F.col("_t") > 0, F.col("_c") * 100.0 / F.col("_t")).otherwise(F.lit(0.0)).alias("char_accuracy"),
                    "avg_pred_len", "avg_ref_len",
                    F.when(F.col("avg_ref_len") > 0, F.col("avg_pred_len") / F.col("avg_ref_len"))
                    .otherwise(F.lit(0.0)).alias("length_ratio"))


def loss_curve_summary(log: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """A-23: first and last loss per run, improvement %, verdict band (< .5 good, < 1 more
    epochs, else high)."""
    a = log.groupBy(run).agg(F.min_by(loss, epoch).alias("initial_loss"), F.max_by(loss, epoch).alias("final_loss"))
    imp = F.when(F.col("initial_loss") != 0,
                 (F.col("initial_loss") - F.col("final_loss")) / F.col("initial_loss") * 100)
    verdict = (F.when(F.col("final_loss") < LOSS_GOOD, F.lit("good"))
               .when(F.col("final_loss") < LOSS_OK, F.lit("more_epochs")).otherwise(F.lit("high")))
    return a.withColumn("improvement_pct", imp).withColumn("verdict", verdict)


def hit_rate(answers: DataFrame, found_col: str = "found") -> DataFrame:
    """A-24: questions asked, found, no-match, success %."""
    return answers.agg(F.count(F.lit(1)).alias("asked"), F.count_if(found_col).alias("found")) \
        .withColumn("no_match", F.col("asked") - F.col("found")) \
        .withColumn("success_pct", F.when(F.col("asked") > 0, F.col("found") * 100.0 / F.col("asked")).otherwise(F.lit(0.0)))


def index_stats(chunks: DataFrame, vec_col: str = "embedding", folder_col: str | None = None) -> DataFrame:
    """A-25: chunk count and vector dimension, overall or per folder."""
    aggs = [F.count(F.lit(1)).alias("n_chunks"), F.max(F.size(vec_col)).alias("dimension")]
    return chunks.groupBy(folder_col).agg(*aggs) if folder_col else chunks.agg(*aggs)


def _postings(docs: DataFrame, id_col: str, text_col: str, min_len: int) -> DataFrame:
    from ..functions.text import metric_tokens
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.explode(F.array_distinct(metric_tokens(text_col))).alias("word")) \
        .filter(F.length("word") >= min_len)


def inverted_index(docs: DataFrame, id_col: str, text_col: str, min_len: int = 4) -> DataFrame:
    """A-26: postings ``(word, doc_id, n_docs)`` for words of at least ``min_len`` chars
    (lower-cased metric tokens). Long form on purpose: a common word's posting list is as
    long as the corpus, so it is never gathered into one array; ``n_docs`` comes from a
    partially aggregated count."""
    words = _postings(docs, id_col, text_col, min_len)
    return words.join(document_frequency(docs, id_col, text_col, min_len), "word")


def document_frequency(docs: DataFrame, id_col: str, text_col: str, min_len: int = 4) -> DataFrame:
    """A-26 keyword count: documents per word (one partially aggregated count)."""
    return _postings(docs, id_col, text_col, min_len).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def batch_split(results: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A-28: successes, failures (with their index) and totals of a batch run."""
    ok = results.filter(F.col(error_col).isNull())
    bad = results.filter(F.col(error_col).isNotNull())
    totals = results.agg(F.count(F.lit(1)).alias("total"),
                         F.count_if(F.col(error_col).isNull()).alias("successful"),
                         F.count_if(F.col(error_col).isNotNull()).alias("failed"))
    return ok, bad, totals
