"""Evaluation queries: chat pairs scored as (prediction = turn i, reference = turn i+1),
labels scored as (prediction = toxic, reference = quality)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as M
from ..operators import stats as A
from ..session import table
from .catalog import register, sql_tokens
from .samples import PAIRS_SQL, _pairs


def _preds(spark, sf):
    p = _pairs(spark, sf)
    return p.select((F.col("channel_id") * 1000000 + F.col("input_ts")).alias("id"),
                    F.col("input").alias("prediction"), F.col("output").alias("reference"))


PRED_SQL = f"""SELECT channel_id * 1000000 + input_ts AS rid, input AS prediction, output AS reference FROM ({PAIRS_SQL})"""


def _grams_sql(tok: str, maxn: int) -> str:
    return (f"SELECT rid, n, unnest(list_transform(range(1, len({tok}) - n + 2), "
            f"lambda i: array_to_string({tok}[i:i+n-1], chr(1)))) AS g "
            f"FROM e, (SELECT unnest(range(1, {maxn + 1})) AS n) ns")


BLEU_SQL = f"""
WITH e AS (SELECT rid, {sql_tokens('prediction')} AS pt, {sql_tokens('reference')} AS rt FROM ({PRED_SQL})),
pg AS (SELECT rid, n, g, count(*) AS cnt FROM ({_grams_sql('pt', 4)}) GROUP BY rid, n, g),
rg AS (SELECT rid, n, g, count(*) AS cnt FROM ({_grams_sql('rt', 4)}) GROUP BY rid, n, g),
pn AS (SELECT pg.n, sum(least(pg.cnt, coalesce(rg.cnt, 0))) AS m, sum(pg.cnt) AS c
       FROM pg LEFT JOIN rg ON pg.rid = rg.rid AND pg.n = rg.n AND pg.g = rg.g GROUP BY pg.n),
pr AS (SELECT ns.n, CASE WHEN coalesce(c, 0) = 0 THEN 0.0 WHEN m = 0 THEN 1.0 / (c + 1) ELSE m / c END AS p
       FROM (SELECT unnest(range(1, 5)) AS n) ns LEFT JOIN pn ON ns.n = pn.n),
l AS (SELECT sum(len(pt)) AS lp, sum(len(rt)) AS lr FROM e),
b AS (SELECT CASE WHEN coalesce(lp, 0) = 0 THEN 0.0 WHEN lp >= lr THEN 1.0 ELSE exp(1 - lr / lp) END AS bp FROM l)
SELECT {', '.join(f"round(CASE WHEN min(p) FILTER (WHERE n <= {k}) > 0 THEN any_value(bp) * exp(avg(ln(CASE WHEN p > 0 THEN p END)) FILTER (WHERE n <= {k})) ELSE 0 END, 6) AS bleu_{k}" for k in range(1, 5))},
       round(CASE WHEN min(p) > 0 THEN any_value(bp) * exp(avg(ln(CASE WHEN p > 0 THEN p END))) ELSE 0 END, 6) AS bleu
FROM pr, b"""


@register("chat_bleu", BLEU_SQL)
def chat_bleu(spark, sf):
    """M-01/M-02/M-03: corpus BLEU-1..4 of each turn against the next."""
    b = M.bleu(_preds(spark, sf))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


ROUGE_N_SQL = f"""
WITH e AS (SELECT rid, {sql_tokens('prediction')} AS pt, {sql_tokens('reference')} AS rt FROM ({PRED_SQL})),
pg AS (SELECT rid, n, g, count(*) AS cnt FROM ({_grams_sql('pt', 2)}) GROUP BY rid, n, g),
rg AS (SELECT rid, n, g, count(*) AS cnt FROM ({_grams_sql('rt', 2)}) GROUP BY rid, n, g),
ov AS (SELECT coalesce(pg.rid, rg.rid) AS rid, coalesce(pg.n, rg.n) AS n,
              sum(least(coalesce(pg.cnt, 0), coalesce(rg.cnt, 0))) AS overlap,
              sum(coalesce(pg.cnt, 0)) AS ptot, sum(coalesce(rg.cnt, 0)) AS rtot
       FROM pg FULL OUTER JOIN rg ON pg.rid = rg.rid AND pg.n = rg.n AND pg.g = rg.g GROUP BY 1, 2),
x AS (SELECT e.rid, ns.n, coalesce(overlap, 0) AS overlap, coalesce(ptot, 0) AS ptot, coalesce(rtot, 0) AS rtot
      FROM e CROSS JOIN (SELECT unnest([1, 2]) AS n) ns LEFT JOIN ov ON ov.rid = e.rid AND ov.n = ns.n),
y AS (SELECT n, CASE WHEN ptot > 0 THEN overlap / ptot ELSE 0.0 END AS p,
             CASE WHEN rtot > 0 THEN overlap / rtot ELSE 0.0 END AS r FROM x)
SELECT 'rouge' || n AS rouge_type, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS fmeasure FROM y GROUP BY n"""


@register("chat_rouge_n", ROUGE_N_SQL)
def chat_rouge_n(spark, sf):
    """M-04: ROUGE-1 and ROUGE-2 averaged over pairs."""
    r = M.rouge(_preds(spark, sf), rouge_types=("rouge1", "rouge2"))
    return r.select("rouge_type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fmeasure")])


#: The table of longest common subsequences, a row (one token of the prediction) at a time.
ROUGE_L_SQL = f"""
WITH RECURSIVE e AS (SELECT rid, {sql_tokens('prediction')} AS pt, {sql_tokens('reference')} AS rt FROM ({PRED_SQL})),
t(rid, i, l) AS (
  SELECT rid, CAST(0 AS BIGINT), list_transform(rt, lambda x: 0) FROM e WHERE len(pt) > 0 AND len(rt) > 0
  UNION ALL
  SELECT rid, i, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT t.rid, t.i + 1 AS i, list_transform(range(1, len(e.rt) + 1), lambda j:
      CASE WHEN e.rt[j] = e.pt[t.i + 1] THEN (CASE WHEN j > 1 THEN t.l[j - 1] ELSE 0 END) + 1 ELSE t.l[j] END) AS c
    FROM t JOIN e ON e.rid = t.rid AND t.i < len(e.pt)) x),
s AS (SELECT e.rid, len(pt) AS np, len(rt) AS nr, coalesce(list_max(t.l), 0) AS lcs FROM e LEFT JOIN t ON t.rid = e.rid AND t.i = len(e.pt)),
y AS (SELECT CASE WHEN np > 0 AND nr > 0 THEN lcs / np ELSE 0.0 END AS p, CASE WHEN np > 0 AND nr > 0 THEN lcs / nr ELSE 0.0 END AS r FROM s)
SELECT 'rougeL' AS rouge_type, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS fmeasure FROM y"""


@register("chat_rouge_l", ROUGE_L_SQL)
def chat_rouge_l(spark, sf):
    """M-05: ROUGE-L via the LCS kernel (UD-03)."""
    r = M.rouge(_preds(spark, sf), rouge_types=("rougeL",))
    return r.select("rouge_type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fmeasure")])


def sql_norm_answer(e: str) -> str:
    w = "[^\\p{L}\\p{N}_]"
    t = f"lower(coalesce({e}, ''))"
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|{w})(a|an|the)({w}|$)', '\\1 \\3', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@register("chat_exact_match", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {sql_norm_answer('prediction')} = {sql_norm_answer('reference')}) AS matches,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {sql_norm_answer('prediction')} = {sql_norm_answer('reference')}) / count(*) ELSE 0 END, 6) AS exact_match
FROM ({PRED_SQL})""")
def chat_exact_match(spark, sf):
    """M-08 normalised exact match."""
    return M.exact_match(_preds(spark, sf)).withColumn("exact_match", F.round("exact_match", 6))


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("prediction"), F.col("quality").alias("reference"))


@register("label_accuracy", """
SELECT count(*) AS total, count(*) FILTER (WHERE toxic IS NOT DISTINCT FROM quality) AS correct,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE toxic IS NOT DISTINCT FROM quality) / count(*) ELSE 0 END, 6) AS accuracy
FROM labels""")
def label_accuracy(spark, sf):
    """M-06 accuracy of toxic-as-prediction against quality."""
    return M.accuracy(_labels(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


F1_CLASS_SQL = """
WITH lab AS (SELECT toxic AS label FROM labels UNION SELECT quality FROM labels),
c AS (SELECT l.label, count(*) FILTER (WHERE toxic = l.label AND quality = l.label) AS tp,
             count(*) FILTER (WHERE toxic = l.label AND quality IS DISTINCT FROM l.label) AS fp,
             count(*) FILTER (WHERE toxic IS DISTINCT FROM l.label AND quality = l.label) AS fn
      FROM lab l CROSS JOIN labels GROUP BY l.label),
m AS (SELECT label, tp, fp, fn, tp + fn AS support,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT label, tp, fp, fn, support, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m"""


@register("label_f1_classes", F1_CLASS_SQL.replace("SELECT label, tp, fp, fn, support, precision, recall,\n       CASE",
                                                   "SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,\n       round(CASE")
          .replace("ELSE 0.0 END AS f1 FROM m", "ELSE 0.0 END, 6) AS f1 FROM m"))
def label_f1_classes(spark, sf):
    """M-07 per-class confusion counts, precision, recall, F1, support."""
    c = M.f1_per_class(_labels(spark, sf))
    return c.select(F.col("label").cast("int").alias("label"), "tp", "fp", "fn", "support",
                    *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@register("label_f1_averages", f"""
WITH pc AS ({F1_CLASS_SQL}), acc AS (SELECT count(*) FILTER (WHERE toxic = quality) / count(*) AS a FROM labels)
SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pc
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6) FROM pc
UNION ALL SELECT 'micro', round(a, 6), round(a, 6), round(a, 6) FROM acc""")
def label_f1_averages(spark, sf):
    """M-07 macro, weighted and micro averages."""
    u = M.f1_averages(_labels(spark, sf))
    return u.select("average", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("label_metric_bundle", f"""
WITH pc AS ({F1_CLASS_SQL}),
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE toxic IS NOT DISTINCT FROM quality) AS correct FROM labels)
SELECT 'accuracy' AS metric, 'accuracy' AS sub_metric, round(correct / total, 6) AS value FROM a
UNION ALL SELECT 'accuracy', 'correct', correct FROM a UNION ALL SELECT 'accuracy', 'total', total FROM a
UNION ALL SELECT 'f1', 'precision', round(avg(precision), 6) FROM pc
UNION ALL SELECT 'f1', 'recall', round(avg(recall), 6) FROM pc
UNION ALL SELECT 'f1', 'f1', round(avg(f1), 6) FROM pc""")
def label_metric_bundle(spark, sf):
    """M-10 classification bundle in the long metric form."""
    b = M.metric_bundle(_labels(spark, sf), "classification").filter(F.col("error").isNull())
    return b.select("metric", "sub_metric", F.round("value", 6).alias("value"))


@register("chat_error_types", f"""
WITH e AS (SELECT * FROM ({PRED_SQL}) WHERE prediction IS DISTINCT FROM reference),
t AS (SELECT CASE WHEN length(prediction) < length(reference) * 0.5 THEN 'too_short'
                  WHEN length(prediction) > length(reference) * 1.5 THEN 'too_long'
                  WHEN lower(prediction) = lower(reference) THEN 'case_mismatch' ELSE 'content_error' END AS error_type FROM e)
SELECT error_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM t GROUP BY error_type""")
def chat_error_types(spark, sf):
    """A-20 error-type distribution of turn-as-prediction against the next turn."""
    return A.error_analysis(_preds(spark, sf), "prediction", "reference", conf=None)["types"]


@register("chat_char_accuracy", f"""
WITH p AS (SELECT coalesce(prediction, '') AS p, coalesce(reference, '') AS r FROM ({PRED_SQL})),
x AS (SELECT p = r AS em, len(list_filter(range(1, least(length(p), length(r)) + 1), lambda i: substr(p, i, 1) = substr(r, i, 1))) AS c,
             least(length(p), length(r)) AS t, length(p) AS lp, length(r) AS lr FROM p)
SELECT round(avg(CAST(em AS DOUBLE)) * 100, 6) AS exact_match,
  round(CASE WHEN sum(t) > 0 THEN sum(c) * 100.0 / sum(t) ELSE 0 END, 6) AS char_accuracy,
  round(avg(lp), 6) AS avg_pred_len, round(avg(lr), 6) AS avg_ref_len,
  round(CASE WHEN avg(lr) > 0 THEN avg(lp) / avg(lr) ELSE 0 END, 6) AS length_ratio FROM x""")
def chat_char_accuracy(spark, sf):
    """A-22 character accuracy, exact match %, lengths."""
    c = A.char_accuracy(_preds(spark, sf), "prediction", "reference")
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


def _metric_table(spark, sf):
    """Long metric table (model, dataset, metric, sub_metric, value): two prediction rules
    ("echo" = the turn itself, "lower" = lower-cased turn) scored by normalised exact match and
    accuracy on two datasets (pairs starting with a user vs an assistant turn). One grouped
    pass computes every (model, dataset) count; ``stack`` turns it into the long form."""
    from ..functions.text import normalize_answer
    p = _pairs(spark, sf).filter(F.col("input_role").isin("user", "assistant"))
    models = {"echo": F.col("input"), "lower": F.lower("input")}
    ref_n = normalize_answer("output")
    aggs = [F.count(F.lit(1)).alias("total")]
    for m, pred in models.items():
        aggs.append(F.count_if(normalize_answer(pred).eqNullSafe(ref_n)).alias(f"{m}_em"))
        aggs.append(F.count_if(pred.eqNullSafe(F.col("output"))).alias(f"{m}_acc"))
    g = p.groupBy(F.col("input_role").alias("dataset")).agg(*aggs)
    rows = []
    for m in models:
        for metric, sub, val in (("exact_match", "exact_match", F.col(f"{m}_em") / F.col("total")),
                                 ("exact_match", "matches", F.col(f"{m}_em")), ("exact_match", "total", F.col("total")),
                                 ("accuracy", "accuracy", F.col(f"{m}_acc") / F.col("total")),
                                 ("accuracy", "correct", F.col(f"{m}_acc"))):
            rows.append(F.struct(F.lit(m).alias("model"), F.lit(metric).alias("metric"), F.lit(sub).alias("sub_metric"),
                                 val.cast("double").alias("value")))
    return g.select("dataset", F.explode(F.array(*rows)).alias("x")).select("x.model", "dataset", "x.metric", "x.sub_metric", "x.value")


def _metric_sql():
    n = sql_norm_answer
    rows = []
    for model, pred in (("echo", "input"), ("lower", "lower(input)")):
        for ds in ("user", "assistant"):
            src = f"(SELECT {pred} AS prediction, output AS reference FROM ({PAIRS_SQL}) WHERE input_role = '{ds}')"
            em = f"count(*) FILTER (WHERE {n('prediction')} = {n('reference')})"
            ac = "count(*) FILTER (WHERE prediction IS NOT DISTINCT FROM reference)"
            for metric, sub, val in (("exact_match", "exact_match", f"CASE WHEN count(*) > 0 THEN {em} / count(*) ELSE 0 END"),
                                     ("exact_match", "matches", em), ("exact_match", "total", "count(*)"),
                                     ("accuracy", "accuracy", f"CASE WHEN count(*) > 0 THEN {ac} / count(*) ELSE 0 END"),
                                     ("accuracy", "correct", ac)):
                rows.append(f"SELECT '{model}' AS model, '{ds}' AS dataset, '{metric}' AS metric, '{sub}' AS sub_metric, "
                            f"CAST({val} AS DOUBLE) AS value FROM {src}")
    return " UNION ALL ".join(rows)


ROLLUP_SQL = f"""
WITH m AS ({_metric_sql()})
SELECT model, CASE WHEN sub_metric = metric THEN metric ELSE metric || '_' || sub_metric END AS metric_key,
  round(CASE WHEN max(CASE WHEN sub_metric IN ('matches', 'total', 'correct') THEN 1 ELSE 0 END) = 1 THEN sum(value) ELSE avg(value) END, 6) AS value,
  count(*) AS n_datasets FROM m GROUP BY 1, 2"""


@register("benchmark_rollup", ROLLUP_SQL)
def benchmark_rollup(spark, sf):
    """M-11: per model, scores averaged over datasets and counters summed."""
    r = M.benchmark_rollup(_metric_table(spark, sf))
    return r.withColumn("value", F.round("value", 6))


@register("benchmark_deltas", f"""
WITH r AS ({ROLLUP_SQL})
SELECT a.model, a.metric_key, round(a.value - b.value, 6) AS delta FROM r a JOIN r b ON a.metric_key = b.metric_key
WHERE b.model = 'echo' AND a.model <> 'echo'""")
def benchmark_deltas(spark, sf):
    """M-12: deltas against the "echo" baseline."""
    r = M.compare_to_baseline(M.benchmark_rollup(_metric_table(spark, sf)), "echo")
    return r.withColumn("delta", F.round("delta", 6))


@register("benchmark_best", f"""
WITH r AS ({ROLLUP_SQL}), s AS (SELECT model, coalesce(max(value) FILTER (WHERE metric_key = 'exact_match'), 0) AS score FROM r GROUP BY model)
SELECT arg_min(model, (-score, model)) AS model, round(max(score), 6) AS score FROM s""")
def benchmark_best(spark, sf):
    """M-13: best model by the primary metric (exact match), first on ties."""
    b = M.best_model(M.benchmark_rollup(_metric_table(spark, sf)), "exact_match")
    return b.select("model", F.round("score", 6).alias("score"))


@register("benchmark_table", f"""
WITH m AS ({_metric_sql()}),
p AS (SELECT model, max(value) FILTER (WHERE dataset = 'user') AS "user", max(value) FILTER (WHERE dataset = 'assistant') AS assistant
      FROM m WHERE metric = 'exact_match' AND sub_metric = 'exact_match' GROUP BY model)
SELECT model, round("user", 6) AS "user", round(assistant, 6) AS assistant,
  round((coalesce("user", 0) + coalesce(assistant, 0)) / 2, 6) AS "Average",
  (coalesce("user", 0) + coalesce(assistant, 0)) / 2 = max((coalesce("user", 0) + coalesce(assistant, 0)) / 2) OVER () AS best FROM p""")
def benchmark_table(spark, sf):
    """M-14: model x dataset exact-match table with Average and best flag."""
    t = M.comparison_table(_metric_table(spark, sf), "exact_match", ["user", "assistant"])
    return t.select("model", F.round("user", 6).alias("user"), F.round("assistant", 6).alias("assistant"),
                    F.round("Average", 6).alias("Average"), "best")


@register("chat_predictions")
def chat_predictions(spark, sf):
    """UD-02 prediction plug point (a user batch function: first sentence, failing on empty
    input) feeding A-28 outcome totals (rows-only: the predictor is user code)."""
    import pandas as pd

    def first_sentence(s: pd.Series) -> pd.Series:
        if (s.str.len() == 0).any():
            raise ValueError("empty input")
        return s.str.split(".").str[0]

    p = M.predict(_preds(spark, sf).select("id", F.col("prediction").alias("input")), first_sentence)
    return A.batch_split(p)[2]


@register("chat_confidence_evaluation", f"""
WITH p AS (SELECT prediction, reference, least(1.0, length(prediction) / greatest(length(reference), 1)) AS confidence FROM ({PRED_SQL}))
SELECT count(*) AS total, count(*) FILTER (WHERE prediction = reference) AS correct,
  round(coalesce(avg(CASE WHEN prediction = reference THEN 1.0 ELSE 0.0 END), 0), 6) AS accuracy,
  round(avg(confidence) FILTER (WHERE prediction = reference), 6) AS avg_conf_correct,
  round(avg(confidence) FILTER (WHERE NOT (prediction = reference)), 6) AS avg_conf_wrong,
  count(*) FILTER (WHERE NOT (prediction = reference)) AS errors FROM p""")
def chat_confidence_evaluation(spark, sf):
    """A-19 accuracy and mean confidence of right / wrong answers; confidence = length ratio
    of prediction to reference (capped at 1)."""
    p = _preds(spark, sf).withColumn(
        "confidence", F.least(F.lit(1.0), F.length("prediction") / F.greatest(F.length("reference"), F.lit(1))))
    r = A.confidence_evaluation(p, "prediction", "reference", "confidence")
    return r.select("total", "correct", F.round("accuracy", 6).alias("accuracy"),
                    F.round("avg_conf_correct", 6).alias("avg_conf_correct"),
                    F.round("avg_conf_wrong", 6).alias("avg_conf_wrong"), "errors")


def _loss_log(spark, sf):
    """Training-log shaped table from events: run = event type, epoch = day, loss = mean value / 100."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(
        (F.avg("value") / 100).alias("loss"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("n_tokens"))


LOSS_LOG_SQL = """SELECT event_type AS run_id, day(ts) AS epoch, avg(value) / 100 AS loss,
  sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_tokens FROM events GROUP BY 1, 2"""


@register("loss_curves", f"""
WITH l AS ({LOSS_LOG_SQL}), a AS (SELECT run_id, arg_min(loss, epoch) AS initial_loss, arg_max(loss, epoch) AS final_loss FROM l GROUP BY run_id)
SELECT run_id, round(initial_loss, 6) AS initial_loss, round(final_loss, 6) AS final_loss,
  round(CASE WHEN initial_loss <> 0 THEN (initial_loss - final_loss) / initial_loss * 100 END, 6) AS improvement_pct,
  CASE WHEN final_loss < 0.5 THEN 'good' WHEN final_loss < 1.0 THEN 'more_epochs' ELSE 'high' END AS verdict FROM a""")
def loss_curves(spark, sf):
    """A-23 loss-curve summary per run over a training-log table derived from events."""
    s = A.loss_curve_summary(_loss_log(spark, sf))
    return s.select("run_id", F.round("initial_loss", 6).alias("initial_loss"), F.round("final_loss", 6).alias("final_loss"),
                    F.round("improvement_pct", 6).alias("improvement_pct"), "verdict")


@register("run_perplexity", f"""
WITH l AS ({LOSS_LOG_SQL}), a AS (SELECT run_id, sum(loss * n_tokens) / sum(n_tokens) AS loss, sum(n_tokens) AS total_tokens FROM l GROUP BY run_id)
SELECT run_id, round(CASE WHEN loss < 100 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity, round(loss, 6) AS loss,
  CAST(total_tokens AS BIGINT) AS total_tokens FROM a""")
def run_perplexity(spark, sf):
    """M-09 perplexity per run from per-batch (loss, tokens) rows (batches = days)."""
    u = M.perplexity(_loss_log(spark, sf), group="run_id")
    return u.select("run_id", F.round("perplexity", 6).alias("perplexity"), F.round("loss", 6).alias("loss"),
                    F.col("total_tokens").cast("bigint").alias("total_tokens"))
