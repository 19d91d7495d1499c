"""Evaluation metrics over prediction tables (M-01 ... M-14).

Input is a table with a row id, a prediction and a reference (or a separate reference table
for several references per row). Metric results come out as one row per metric, or in the
long form ``(metric, sub_metric, value)``.

N-gram metrics with the reference in the same row count n-grams inside the row (Arrow kernel);
texts alone are shuffled, by row id. With several references per row n-grams are exploded and
counted per (row, n, gram) with partial aggregation, and both counts are joined on these keys.
No hot key exists: the row id is part of every key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import gram_matches_udf, lcs_udf
from ..functions.text import metric_tokens, ngrams, normalize_answer


def _tok(df: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    return df.select(F.col(id_col).alias("rid"), metric_tokens(text_col).alias(out))


def _gram_counts(tok: DataFrame, tok_col: str, max_n: int, extra: Sequence[str] = ()) -> DataFrame:
    """(rid, *extra, n, gram, cnt) for n = 1..max_n."""
    per_n = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col(tok_col), n).alias("g")) for n in range(1, max_n + 1)])
    e = tok.select("rid", *extra, F.explode(per_n).alias("x")).select("rid", *extra, "x.n", F.explode("x.g").alias("gram"))
    return e.groupBy("rid", *extra, "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def bleu(preds: DataFrame, refs: DataFrame | None = None, id_col: str = "id", pred_col: str = "prediction",
         ref_col: str = "reference", max_n: int = 4, smoothing: bool = True, ref_order: str | None = None) -> DataFrame:
    """M-03 corpus BLEU (dependency-free definition), one row: ``bleu_1 .. bleu_<max_n>, bleu``.

    ``refs`` (``id, reference``; several rows per id allowed) defaults to ``preds[ref_col]``.
    Clipping is against the max count over references, reference length is the closest one
    (ties: the earlier one by ``ref_order``, else by its text), zero matches are smoothed to ``1/(count+1)``; ``bleu`` is the
    highest order computed (D10).
    """
    if refs is None:
        return _bleu_single(preds, id_col, pred_col, ref_col, max_n, smoothing)
    pt = _tok(preds, id_col, pred_col, "pt")
    rt = refs.select(F.col(id_col).alias("rid"), F.col(ref_order or ref_col).alias("ref_no"), metric_tokens(ref_col).alias("rtk"))
    pc = _gram_counts(pt, "pt", max_n)
    rc = (_gram_counts(rt, "rtk", max_n, ["ref_no"]).groupBy("rid", "n", "gram").agg(F.max("cnt").alias("rmax")))
    clipped = pc.join(rc, ["rid", "n", "gram"], "left").select(
        "n", "cnt", F.least("cnt", F.coalesce("rmax", F.lit(0))).alias("m"))
    per_n = clipped.groupBy().pivot("n", list(range(1, max_n + 1))).agg(
        F.sum("m").alias("m"), F.sum("cnt").alias("c"))
    plen = pt.select("rid", F.size("pt").alias("plen"))
    closest = (rt.select("rid", "ref_no", F.size("rtk").alias("rlen")).join(plen, "rid")
               .groupBy("rid").agg(F.min_by("rlen", F.struct(F.abs(F.col("rlen") - F.col("plen")), F.col("ref_no"))).alias("rlen")))
    lens = plen.join(closest, "rid", "left").agg(F.sum("plen").alias("P"), F.sum(F.coalesce("rlen", F.lit(0))).alias("R"))
    from .relate import with_one_row
    d = with_one_row(per_n, lens)  # two one-row aggregates
    return _bleu_from_counts(d, max_n, smoothing)


def _matches(preds: DataFrame, id_col: str, pred_col: str, ref_col: str, orders) -> DataFrame:
    """(rid, plen, rlen, n, m, pc, rc): shared n-grams and those of either side, for every row id and
    order. The n-grams are counted inside the row; only texts are shuffled, by their id."""
    pair = F.struct(F.col(pred_col).alias("p"), F.col(ref_col).alias("r"))
    rows = preds.groupBy(F.col(id_col).alias("rid")).agg(F.collect_list(pair).alias("x"))
    d = rows.select("rid", F.transform("x", lambda x: metric_tokens(x["p"])).alias("pt"), F.transform("x", lambda x: metric_tokens(x["r"])).alias("rtk"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + F.size(t))
    d = d.select("rid", words("pt").alias("plen"), words("rtk").alias("rlen"), gram_matches_udf(orders)("pt", "rtk").alias("c"))
    return d.select("rid", "plen", "rlen", F.explode("c").alias("c")).select("rid", "plen", "rlen", "c.*")


def _bleu_single(preds, id_col, pred_col, ref_col, max_n, smoothing):
    g = _matches(preds, id_col, pred_col, ref_col, range(1, max_n + 1))
    of = lambda n, c: F.sum(F.when(F.col("n") == n, F.col(c)))
    orders = range(1, max_n + 1)
    d = g.agg(*[of(n, "m").alias(f"{n}_m") for n in orders], *[of(n, "pc").alias(f"{n}_c") for n in orders],
              of(1, "plen").alias("P"), of(1, "rlen").alias("R"))
    return _bleu_from_counts(d, max_n, smoothing)


def _bleu_from_counts(d: DataFrame, max_n: int, smoothing: bool) -> DataFrame:
    prec = []
    for n in range(1, max_n + 1):
        m, c = F.coalesce(F.col(f"{n}_m"), F.lit(0)), F.coalesce(F.col(f"{n}_c"), F.lit(0))
        p = F.when(c == 0, F.lit(0.0)).when(m == 0, (1.0 / (c + 1)) if smoothing else F.lit(0.0)).otherwise(m / c)
        prec.append(p)
    bp = F.when(F.coalesce("P", F.lit(0)) == 0, F.lit(0.0)).when(F.col("P") >= F.col("R"), F.lit(1.0)) \
        .otherwise(F.exp(1 - F.col("R") / F.col("P")))
    outs = []
    for n in range(1, max_n + 1):
        ps = prec[:n]
        all_pos = reduce(lambda a, b: a & b, [p > 0 for p in ps])
        logmean = reduce(lambda a, b: a + b, [F.log(F.when(p > 0, p)) for p in ps]) / n
        outs.append(F.when(all_pos, bp * F.exp(logmean)).otherwise(F.lit(0.0)).alias(f"bleu_{n}"))
    r = d.select(*outs)
    return r.withColumn("bleu", F.col(f"bleu_{max_n}"))


def rouge_n_rows(preds: DataFrame, id_col: str = "id", pred_col: str = "prediction",
                 ref_col: str = "reference", orders: Sequence[int] = (1, 2)) -> DataFrame:
    """M-04 per-row ROUGE-N: ``rid, n, precision, recall, fmeasure``."""
    d = _matches(preds, id_col, pred_col, ref_col, orders).select(
        "rid", "n", F.col("m").alias("overlap"), F.col("pc").alias("ptot"), F.col("rc").alias("rtot"))
    p = F.when(F.col("ptot") > 0, F.col("overlap") / F.col("ptot")).otherwise(F.lit(0.0))
    r = F.when(F.col("rtot") > 0, F.col("overlap") / F.col("rtot")).otherwise(F.lit(0.0))
    d = d.select("rid", "n", p.alias("precision"), r.alias("recall"))
    f = F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return d.withColumn("fmeasure", f)


def rouge_l_rows(preds: DataFrame, id_col: str = "id", pred_col: str = "prediction",
                 ref_col: str = "reference") -> DataFrame:
    """M-05 per-row ROUGE-L from the LCS of token lists (Arrow kernel, rest native)."""
    d = preds.select(F.col(id_col).alias("rid"), metric_tokens(pred_col).alias("pt"), metric_tokens(ref_col).alias("rtk"))
    d = d.withColumn("lcs", lcs_udf("pt", "rtk"))
    ok = (F.size("pt") > 0) & (F.size("rtk") > 0)
    p = F.when(ok, F.col("lcs") / F.size("pt")).otherwise(F.lit(0.0))
    r = F.when(ok, F.col("lcs") / F.size("rtk")).otherwise(F.lit(0.0))
    d = d.select("rid", p.alias("precision"), r.alias("recall"))
    f = F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return d.withColumn("fmeasure", f)


def rouge(preds: DataFrame, id_col: str = "id", pred_col: str = "prediction", ref_col: str = "reference",
          rouge_types: Sequence[str] = ("rouge1", "rouge2", "rougeL")) -> DataFrame:
    """M-04 / M-05: averaged ROUGE, long form ``(rouge_type, precision, recall, fmeasure)``."""
    parts = []
    orders = [int(t[-1]) for t in rouge_types if t in ("rouge1", "rouge2")]
    if orders:
        rn = rouge_n_rows(preds, id_col, pred_col, ref_col, orders)
        parts.append(rn.withColumn("rouge_type", F.concat(F.lit("rouge"), F.col("n").cast("string"))).drop("n"))
    if "rougeL" in rouge_types:
        parts.append(rouge_l_rows(preds, id_col, pred_col, ref_col).withColumn("rouge_type", F.lit("rougeL")))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.groupBy("rouge_type").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                       F.avg("fmeasure").alias("fmeasure"))


def accuracy(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """M-06: accuracy, correct, total (0 when empty); NULL equals NULL."""
    right = F.col(pred).eqNullSafe(F.col(ref))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct")).withColumn(
        "accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))


def f1_per_class(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                 labels: Sequence | None = None) -> DataFrame:
    """M-07 per-class tp, fp, fn, precision, recall, f1, support.

    One scan: every row adds itself to its predicted label (pred_n, and tp when the prediction
    is right) and to its reference label (support); one aggregation by label (partial before
    the shuffle). Classes are the union of predictions and references unless ``labels`` given.
    """
    p, r = F.col(pred), F.col(ref)
    if labels is not None:
        p, r = p.cast("string"), r.cast("string")
    hit = p.eqNullSafe(r).cast("long")
    e = df.select(F.explode(F.array(
        F.struct(p.alias("label"), F.lit(1).cast("long").alias("pn"), F.lit(0).cast("long").alias("rn"), hit.alias("tp")),
        F.struct(r.alias("label"), F.lit(0).cast("long").alias("pn"), F.lit(1).cast("long").alias("rn"), F.lit(0).cast("long").alias("tp")))).alias("x"))
    d = e.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.tp").alias("tp"), F.sum("x.pn").alias("pred_n"),
                                                        F.sum("x.rn").alias("support"))
    if labels is not None:
        lab = df.sparkSession.createDataFrame([(str(x),) for x in labels], "label string")
        d = lab.join(d, "label", "left").na.fill(0, ["tp", "pred_n", "support"])
    d = d.select("label", "tp", (F.col("pred_n") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support")
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    d = d.withColumn("precision", pr).withColumn("recall", rc)
    return d.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(F.lit(0.0)))


def f1_averages(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """M-07 macro, weighted and micro averages from one per-class table in one aggregation.
    Micro = accuracy (every row counts once as predicted: sum(tp) / sum(pred_n))."""
    pc = f1_per_class(df, pred, ref)
    s = F.sum("support")
    a = pc.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
               *[F.when(s > 0, F.sum(F.col(m) * F.col("support")) / s).otherwise(F.lit(0.0)).alias(f"weighted_{m}")
                 for m in ("precision", "recall", "f1")],
               F.when(F.sum(F.col("tp") + F.col("fp")) > 0, F.sum("tp") / F.sum(F.col("tp") + F.col("fp")))
               .otherwise(F.lit(0.0)).alias("micro"))
    rows = [F.struct(F.lit("macro").alias("average"), *[F.col(f"macro_{m}").alias(m) for m in ("precision", "recall", "f1")]),
            F.struct(F.lit("weighted").alias("average"), *[F.col(f"weighted_{m}").alias(m) for m in ("precision", "recall", "f1")]),
            F.struct(F.lit("micro").alias("average"), *[F.col("micro").alias(m) for m in ("precision", "recall", "f1")])]
    return a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def f1(df: DataFrame, pred: str = "prediction", ref: str = "reference", average: str = "macro",
       labels: Sequence | None = None) -> DataFrame:
    """M-07 averaged F1: one row ``(average, precision, recall, f1)``."""
    if average == "micro":
        a = accuracy(df, pred, ref)
        return a.select(F.lit("micro").alias("average"), F.col("accuracy").alias("precision"),
                        F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"))
    pc = f1_per_class(df, pred, ref, labels)
    if average == "weighted":
        s = F.sum("support")
        out = pc.agg(*[F.when(s > 0, F.sum(F.col(m) * F.col("support")) / s).otherwise(F.lit(0.0)).alias(m)
                       for m in ("precision", "recall", "f1")])
    else:
        out = pc.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")])
    return out.select(F.lit(average).alias("average"), "precision", "recall", "f1")


def exact_match(df: DataFrame, pred: str = "prediction", ref: str = "reference", normalize: bool = True) -> DataFrame:
    """M-08: exact match rate, matches, total."""
    p, r = (normalize_answer(pred), normalize_answer(ref)) if normalize else (F.col(pred), F.col(ref))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(p.eqNullSafe(r)).alias("matches")).withColumn(
        "exact_match", F.when(F.col("total") > 0, F.col("matches") / F.col("total")).otherwise(F.lit(0.0)))


def perplexity(batches: DataFrame, loss: str = "loss", tokens: str = "n_tokens", group=()) -> DataFrame:
    """M-09: exp of the token-weighted mean loss; +inf when the mean is >= 100 or no tokens.
    With ``group`` (e.g. run id) one row per group, in one aggregation."""
    group = [group] if isinstance(group, str) else list(group)
    a = batches.groupBy(*group).agg(F.sum(F.col(loss) * F.col(tokens)).alias("_l"), F.sum(tokens).alias("total_tokens"))
    avg_loss = F.when(F.coalesce("total_tokens", F.lit(0)) > 0, F.col("_l") / F.col("total_tokens")).otherwise(F.lit(float("inf")))
    a = a.withColumn("loss", avg_loss)
    return a.select(*group, F.when(F.col("loss") < 100, F.exp("loss")).otherwise(F.lit(float("inf"))).alias("perplexity"),
                    "loss", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


def _long(df: DataFrame, metric: str, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(metric).alias("metric"), F.lit(c).alias("sub_metric"),
                                                  F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.*")


#: Metrics of each task type; any other type counts as generation.
TASK_METRICS = {"classification": ("accuracy", "f1"), "qa": ("exact_match", "f1"), "generation": ("bleu", "rouge", "exact_match")}


def _metric(name: str, df: DataFrame, task_type: str, id_col: str, pred: str, ref: str) -> DataFrame:
    if name == "accuracy":
        return _long(accuracy(df, pred, ref), name, ["accuracy", "correct", "total"])
    if name == "exact_match":
        return _long(exact_match(df, pred, ref), name, ["exact_match", "matches", "total"])
    if name == "f1" and task_type == "qa":  # micro, over space-joined token labels (D3)
        toks = df.select(F.array_join(metric_tokens(pred), " ").alias("p"), F.array_join(metric_tokens(ref), " ").alias("r"))
        return _long(f1(toks, "p", "r", "micro"), name, ["precision", "recall", "f1"])
    if name == "f1":
        return _long(f1(df, pred, ref, "macro"), name, ["precision", "recall", "f1"])
    if name == "bleu":
        return _long(bleu(df, None, id_col, pred, ref), name, ["bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4"])
    if name == "rouge":
        per_type = F.array(*[F.struct(F.lit(name).alias("metric"), F.concat("rouge_type", F.lit("_" + m)).alias("sub_metric"),
                                      F.col(m).alias("value")) for m in ("precision", "recall", "fmeasure")])
        return rouge(df, id_col, pred, ref).select(F.explode(per_type).alias("x")).select("x.*")
    raise ValueError(f"unknown metric {name}")


def metric_bundle(df: DataFrame, task_type: str = "generation", id_col: str = "id", pred: str = "prediction",
                  ref: str = "reference", metrics: Sequence[str] | None = None) -> DataFrame:
    """M-10: the metrics of a task type (or those named) as one long table ``(metric, sub_metric,
    value, error)``. A metric that cannot be computed (unknown, or a column it needs is missing)
    leaves one row with its message in ``error`` and the others stay."""
    from pyspark.errors import PySparkException
    parts = []
    for name in metrics or TASK_METRICS.get(task_type, TASK_METRICS["generation"]):
        try:
            parts.append(_metric(name, df, task_type, id_col, pred, ref).withColumn("error", F.lit(None).cast("string")))
        except (PySparkException, ValueError) as e:
            parts.append(df.sparkSession.createDataFrame([(name, "error", None, str(e).split("\n")[0])],
                                                         "metric string, sub_metric string, value double, error string"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ------------------------------------------------------------------ benchmark roll-ups (M-11 ... M-14)

COUNTER_SUBS = ("matches", "total", "correct")


def benchmark_rollup(metrics: DataFrame) -> DataFrame:
    """M-11: mean over datasets of every score per (model, metric key). Counters are summed,
    not averaged (D11); ROUGE keeps fmeasure only. ``metric_key`` is ``metric`` when the
    sub-metric has the metric's name, else ``metric_sub``."""
    m = metrics.filter(~((F.col("metric") == "rouge") & ~F.col("sub_metric").endswith("fmeasure")))
    key = F.when(F.col("sub_metric").isNull() | (F.col("sub_metric") == F.col("metric")), F.col("metric")) \
        .otherwise(F.concat_ws("_", "metric", F.regexp_replace("sub_metric", "_fmeasure$", "")))
    is_counter = F.col("sub_metric").isin(*COUNTER_SUBS)
    return m.groupBy("model", key.alias("metric_key")).agg(
        F.when(F.max(is_counter.cast("int")) == 1, F.sum("value")).otherwise(F.avg("value")).alias("value"),
        F.count(F.lit(1)).alias("n_datasets"))


def compare_to_baseline(rollup: DataFrame, baseline_model: str) -> DataFrame:
    """M-12: ``value - baseline value`` for metrics the baseline has too."""
    b = rollup.filter(F.col("model") == baseline_model).select("metric_key", F.col("value").alias("baseline"))
    return rollup.filter(F.col("model") != baseline_model).join(b, "metric_key") \
        .select("model", "metric_key", (F.col("value") - F.col("baseline")).alias("delta"))


def best_model(rollup: DataFrame, primary_metric: str = "bleu", model_order: str | None = None) -> DataFrame:
    """M-13: model with the highest primary metric (missing = 0), first on ties."""
    models = rollup.select("model", *( [model_order] if model_order else [])).distinct()
    s = models.join(rollup.filter(F.col("metric_key") == primary_metric).select("model", "value"), "model", "left") \
        .withColumn("score", F.coalesce("value", F.lit(0.0)))
    tie = F.col(model_order) if model_order else F.col("model")
    return s.agg(F.min_by(F.struct("model", "score"), F.struct(-F.col("score"), tie)).alias("b")).select("b.model", "b.score")


def comparison_table(metrics: DataFrame, metric_key: str, datasets: Sequence[str]) -> DataFrame:
    """M-14: model x dataset pivot of one metric plus Average and a best flag."""
    m = metrics.withColumn("metric_key", F.when(F.col("sub_metric") == F.col("metric"), F.col("metric"))
                           .otherwise(F.concat_ws("_", "metric", "sub_metric"))).filter(F.col("metric_key") == metric_key)
    p = m.groupBy("model").pivot("dataset", list(datasets)).agg(F.first("value"))
    avg = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{d}`"), F.lit(0.0)) for d in datasets]) / len(datasets)
    p = p.withColumn("Average", avg)
    return p.withColumn("best", F.col("Average") == F.max("Average").over(Window.partitionBy()))


def predict(samples: DataFrame, fn, input_col: str = "input", out: str = "prediction") -> DataFrame:
    """UD-02: run a user predictor over a sample table in Arrow batches.

    ``fn`` maps a pandas Series of inputs to a Series of predictions. If it fails on a batch,
    that batch is retried row by row so the failing rows carry their ``error`` text (A-28
    splits on it) and the others keep their prediction.
    """
    import pandas as pd

    cols = samples.columns
    from pyspark.sql import types as T
    schema = T.StructType(samples.schema.fields + [T.StructField(out, T.StringType(), True),
                                                   T.StructField("error", T.StringType(), True)])

    def run(it):
        for pdf in it:
            try:
                preds = list(fn(pdf[input_col]))
                errs = [None] * len(pdf)
            except Exception:  # noqa: BLE001 - isolate the failing rows
                preds, errs = [], []
                for x in pdf[input_col]:
                    try:
                        preds.append(list(fn(pd.Series([x])))[0])
                        errs.append(None)
                    except Exception as e:  # noqa: BLE001
                        preds.append(None)
                        errs.append(f"{type(e).__name__}: {e}")
            res = pdf[cols].copy()
            res[out] = [None if p is None else str(p) for p in preds]
            res["error"] = errs
            yield res

    return samples.mapInPandas(run, schema)
