import math
import random

from pyspark.sql import functions as F

from corpuskit.functions.kernels import lcs_length
from corpuskit.operators import evaluation as M
from corpuskit.operators import stats as A


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_lcs_bitparallel_matches_dp():
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))]
        assert lcs_length(a, b) == _lcs_dp(a, b)
    assert lcs_length(["the", "cat", "sat"], ["the", "dog", "cat", "sat"]) == 3


def test_bleu_identical_and_disjoint(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"),
                               (2, "a b c d e", "a b c d e")], "id int, prediction string, reference string")
    r = M.bleu(d).first()
    assert abs(r.bleu - 1.0) < 1e-12 and abs(r.bleu_1 - 1.0) < 1e-12
    d2 = spark.createDataFrame([(1, "x y z", "a b c")], "id int, prediction string, reference string")
    r2 = M.bleu(d2).first()
    # no matches anywhere: smoothed precisions 1/(c+1), brevity 1
    assert r2.bleu_1 == 1 / 4 and r2.bleu_4 == 0.0  # 4-grams: count 0 -> precision 0


def test_bleu_multi_reference_clipping(spark):
    p = spark.createDataFrame([(1, "the the the the")], "id int, prediction string")
    refs = spark.createDataFrame([(1, "the cat"), (1, "the the dog")], "id int, reference string")
    r = M.bleu(p, refs, max_n=1).first()
    # clipped unigram matches = max over refs = 2 of 4; closest ref length to 4 is 3 -> bp 1
    assert abs(r.bleu_1 - 0.5) < 1e-12 and r.bleu == r.bleu_1


def test_rouge_l_row(spark):
    d = spark.createDataFrame([(1, "the cat sat", "the dog cat sat down")], "id int, prediction string, reference string")
    r = M.rouge_l_rows(d).first()
    assert abs(r.precision - 1.0) < 1e-12 and abs(r.recall - 0.6) < 1e-12


def test_f1_micro_macro_weighted(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "prediction string, reference string")
    macro = M.f1(d, average="macro").first()
    # a: p=.5 r=1 f=2/3; b: p=1 r=1/3 f=.5; c: 0
    assert abs(macro.f1 - (2 / 3 + 0.5 + 0) / 3) < 1e-9
    micro = M.f1(d, average="micro").first()
    assert micro.f1 == 0.5
    w = M.f1(d, average="weighted").first()
    assert abs(w.f1 - (2 / 3 * 1 + 0.5 * 3) / 4) < 1e-9


def test_exact_match_normalised(spark):
    d = spark.createDataFrame([("The  Answer!", "answer"), ("an apple", "apple."), ("x", "y")],
                              "prediction string, reference string")
    r = M.exact_match(d).first()
    assert (r.matches, r.total) == (2, 3)


def test_perplexity(spark):
    d = spark.createDataFrame([(1, 2.0, 10), (2, 4.0, 30)], "batch_id int, loss double, n_tokens int")
    r = M.perplexity(d).first()
    assert abs(r.loss - 3.5) < 1e-12 and abs(r.perplexity - math.exp(3.5)) < 1e-9
    big = spark.createDataFrame([(1, 150.0, 1)], "batch_id int, loss double, n_tokens int")
    assert M.perplexity(big).first().perplexity == float("inf")
    none = spark.createDataFrame([], "batch_id int, loss double, n_tokens int")
    assert M.perplexity(none).first().perplexity == float("inf")


def test_char_accuracy_against_loop(spark):
    pairs = [("hello", "hallo"), ("abc", "abcdef"), ("", "x"), ("same", "same")]
    d = spark.createDataFrame(pairs, "prediction string, reference string")
    r = A.char_accuracy(d, "prediction", "reference").first()
    c = sum(sum(1 for x, y in zip(p, q) if x == y) for p, q in pairs)
    t = sum(min(len(p), len(q)) for p, q in pairs)
    assert abs(r.char_accuracy - c * 100 / t) < 1e-9 and abs(r.exact_match - 25.0) < 1e-9


def test_benchmark_rollup_compare_best_table(spark):
    rows = [("m1", "d1", "bleu", "bleu", 0.2), ("m1", "d2", "bleu", "bleu", 0.4),
            ("m2", "d1", "bleu", "bleu", 0.5), ("m2", "d2", "bleu", "bleu", 0.3),
            ("m1", "d1", "exact_match", "matches", 3.0), ("m1", "d2", "exact_match", "matches", 4.0),
            ("m1", "d1", "rouge", "rouge1_fmeasure", 0.3), ("m1", "d1", "rouge", "rouge1_precision", 0.9)]
    m = spark.createDataFrame(rows, "model string, dataset string, metric string, sub_metric string, value double")
    r = {(x.model, x.metric_key): x.value for x in M.benchmark_rollup(m).collect()}
    assert abs(r[("m1", "bleu")] - 0.3) < 1e-12 and r[("m1", "exact_match_matches")] == 7.0
    assert ("m1", "rouge_rouge1") in r and len([k for k in r if k[1].startswith("rouge")]) == 1
    roll = M.benchmark_rollup(m)
    delta = {x.model: x.delta for x in M.compare_to_baseline(roll, "m1").filter("metric_key = 'bleu'").collect()}
    assert abs(delta["m2"] - 0.1) < 1e-12
    assert M.best_model(roll, "bleu").first().model == "m2"
    assert M.best_model(roll, "missing").first().model == "m1"  # all 0 -> first
    t = M.comparison_table(m, "bleu", ["d1", "d2"]).orderBy("model").collect()
    assert [round(x.Average, 6) for x in t] == [0.3, 0.4] and [x.best for x in t] == [False, True]


def test_predict_plug_point_and_batch_split(spark):
    import pandas as pd

    def model(s: pd.Series) -> pd.Series:
        if (s == "boom").any():
            raise ValueError("bad input")
        return s.str.upper()

    d = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "c")], "id int, input string").coalesce(1)
    p = M.predict(d, model)
    rows = {r.id: (r.prediction, r.error) for r in p.collect()}
    assert rows[1] == ("A", None) and rows[3] == ("C", None) and rows[2][0] is None and "bad input" in rows[2][1]
    ok, bad, tot = A.batch_split(p)
    assert tuple(tot.first()) == (3, 2, 1)


def test_bundle_keeps_the_metrics_that_work(spark):
    d = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "x", "y")], "id long, prediction string, reference string")
    rows = M.metric_bundle(d, "qa", metrics=["exact_match", "nonsense", "f1"]).collect()
    assert {r.metric for r in rows if r.error is None} == {"exact_match", "f1"}
    assert [(r.metric, r.sub_metric, r.value) for r in rows if r.error] == [("nonsense", "error", None)]
    rows = M.metric_bundle(d.drop("id"), "generation").collect()
    assert {r.metric for r in rows if r.error} == {"bleu", "rouge"} and {r.metric for r in rows if not r.error} == {"exact_match"}


def test_closest_reference_ties_by_order(spark):
    p = spark.createDataFrame([(1, "a b c")], "id long, prediction string")
    refs = [(1, "a b", 2), (1, "a b c d", 1)]  # as close as each other
    lens = set()
    for order in ([0, 1], [1, 0]):
        r = spark.createDataFrame([refs[i] for i in order], "id long, reference string, seq int").repartition(2)
        lens.add(M.bleu(p, r, max_n=1, ref_order="seq").first()["bleu_1"])
    assert len(lens) == 1


def test_ngrams_stay_in_their_row(spark):
    """BLEU and ROUGE-N shuffle texts by row id, no n-grams; rows of one id count together."""
    rows = [(1, "a b a b c", "a b c a"), (2, "", "x"), (3, None, None), (4, "q r s t u", "q r s t u"), (4, "a a", "a"), (None, "k l", "k l")]
    d = spark.createDataFrame(rows, "id long, prediction string, reference string")
    out = {(x.rid, x.n): (x.precision, x.recall) for x in M.rouge_n_rows(d).collect()}
    assert out[(1, 1)] == (4 / 5, 1.0) and out[(1, 2)] == (2 / 4, 2 / 3) and out[(2, 1)] == (0.0, 0.0) and out[(3, 2)] == (0.0, 0.0)
    assert out[(4, 1)] == (6 / 7, 1.0) and out[(4, 2)] == (4 / 5, 1.0) and out[(None, 2)] == (1.0, 1.0) and len(out) == 10
    b = M.bleu(d, smoothing=False).first()
    assert abs(b.bleu_1 - 12 / 14) < 1e-12
    for q in (M.bleu(d), M.rouge(d, rouge_types=("rouge1", "rouge2"))):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        assert "gram#" not in plan
