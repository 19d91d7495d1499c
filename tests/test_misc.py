import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import mapping as P
from corpuskit.operators import relate as J
from corpuskit.operators import stats as A
from corpuskit.sources import jsonl as SJ
from corpuskit.sources import sinks as SK
from corpuskit.sources import sql as SQ


def test_record_fallback_and_tickets(spark):
    d = spark.createDataFrame([('{"input": "a", "output": 1}',), ('{"question": "q", "answer": "x"}',),
                               ('{"input": "only"}',), ("bad",)], "value string")
    assert sorted(tuple(r) for r in P.record_fallback(d).collect()) == [("a", "1", "io"), ("q", "x", "qa")]
    t = spark.createDataFrame([(" S ", "D"), ("", "D2"), ("S3", None)], "subject string, description string")
    assert [tuple(r) for r in P.ticket_samples(t).collect()] == [("S", "D")]


def test_records_to_document(spark):
    d = spark.createDataFrame([("f", 2, "b", "B"), ("f", 1, "a", "A")], "file string, seq int, input string, output string")
    r = P.records_to_document(d, "file", "seq").first()
    assert r.text == "Input: a\nOutput: A\n\nInput: b\nOutput: B"


def test_filters(spark):
    d = spark.createDataFrame([(0.95, ["a", "b"], "qa", "ready"), (0.5, ["c"], "qa", "ready")],
                              "confidence double, tags array<string>, task_type string, status string")
    assert P.min_confidence(d, 0.9).count() == 1
    assert P.tags_match(d, ["b", "z"], "qa", "ready").count() == 1


def test_align_by_key_and_position(spark):
    p = spark.createDataFrame([(1, "x"), (2, "y")], "id int, prediction string")
    r = spark.createDataFrame([(1, "x"), (2, "z")], "id int, reference string")
    assert J.align_by_key(p, r, "id").count() == 2
    r2 = spark.createDataFrame([(1, "x")], "id int, reference string")
    with pytest.raises(Exception):
        J.align_by_key(p, r2, "id").collect()
    a = J.align_by_position(p.select(F.col("id").alias("o"), "prediction"), r.select(F.col("id").alias("o2"), "reference"), "o", "o2")
    assert sorted((x.prediction, x.reference) for x in a.collect()) == [("x", "x"), ("y", "z")]


def test_quota_check(spark):
    req = spark.createDataFrame([(1, "t1", "one two three", "m1"), (2, "t2", "a b", "m2"), (3, "t3", "x", "m1"), (4, "zz", "x", "m1")],
                                "request_id int, tenant_id string, text string, model string")
    ten = spark.createDataFrame([("t1", "active", "free"), ("t2", "active", "free"), ("t3", "suspended", "pro")],
                                "tenant_id string, status string, tier string")
    tiers = spark.createDataFrame([("free", 2, ["m1"]), ("pro", 100, [])], "tier string, max_input_tokens int, allowed_models array<string>")
    got = {r.request_id: r.reject_reason for r in J.quota_check(req, ten, tiers).collect()}
    assert got == {1: "input_too_long", 2: "model_not_allowed", 3: "tenant_inactive", 4: "unknown_tenant"}


def test_confidence_eval_and_loss_curve(spark):
    d = spark.createDataFrame([("a", "a", 0.9), ("b", "c", 0.4), ("d", "d", 0.7)], "prediction string, output string, confidence double")
    r = A.confidence_evaluation(d).first()
    assert (r.correct, r.errors) == (2, 1) and abs(r.avg_conf_correct - 0.8) < 1e-12 and r.avg_conf_wrong == 0.4
    log = spark.createDataFrame([("r", 1, 2.0), ("r", 3, 0.4), ("r", 2, 1.0)], "run_id string, epoch int, loss double")
    s = A.loss_curve_summary(log).first()
    assert (s.initial_loss, s.final_loss, s.verdict) == (2.0, 0.4, "good") and abs(s.improvement_pct - 80.0) < 1e-9


def test_index_persist_and_predictions(spark, tmp_path):
    ch = spark.createDataFrame([("c1", "text", [0.1, 0.2])], "id string, content string, embedding array<float>")
    SK.save_index(ch, {"dimension": 2, "model": "m"}, str(tmp_path / "idx"))
    back, cfg = SK.load_index(spark, str(tmp_path / "idx"))
    assert back.count() == 1 and cfg == {"dimension": 2, "model": "m"}
    f = tmp_path / "preds.jsonl"
    f.write_text('{"response": "r1"}\n{"prediction": "p2"}\nplain line\n')
    got = [r.text for r in SJ.load_prediction_lines(spark, str(f), field="response").orderBy("line_num").collect()]
    assert got == ["r1", "p2", "plain line"]


def test_catalog_sql_source(spark):
    spark.createDataFrame([(1, "q", "a")], "id int, question string, answer string").createOrReplaceTempView("faq_tmp")
    s = SQ.catalog_samples(spark, "SELECT * FROM faq_tmp WHERE id = :id", {"input": "question", "output": "answer"}, {"id": 1})
    assert [(r.input, r.output) for r in s.collect()] == [("q", "a")]


def test_newest_and_retention(spark):
    from corpuskit.operators import ranking as W
    t0 = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, t0), (2, None), (3, t0 + dt.timedelta(1)), (4, t0 + dt.timedelta(2))], "id int, ts timestamp")
    assert [r.id for r in W.newest(d, "ts", 3).collect()] == [4, 3, 1]
    assert sorted(r.id for r in W.retain_newest(d, "id", "ts", 2).collect()) == [3, 4]


def test_reaction_samples_and_parent_attach(spark):
    msgs = spark.createDataFrame([
        ("c", "1.0", None, "parent <@U1> question", 2, [("+1", 2)]),
        ("c", "2.0", "1.0", "reply one", 0, []), ("c", "3.0", "1.0", "reply two", 0, []),
        ("c", "4.0", None, "lonely", 0, [("eyes", 1)]), ("c", "5.0", None, "no reactions", 0, [])],
        "channel_id string, ts string, thread_ts string, text string, reply_count int, reactions array<struct<name:string,count:int>>")
    r = {x.metadata.ts: (x.input, x.output) for x in J.reaction_samples(msgs).collect()}
    assert r == {"1.0": ("parent question", "reply one reply two"), "4.0": ("lonely", "")}
    hits = spark.createDataFrame([(1, 0.9), (2, 0.5)], "doc_id int, score double")
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id int, title string, body string")
    assert sorted(tuple(x) for x in J.attach_parent(hits, docs, "doc_id", ["title"]).collect()) == [(1, 0.9, "a"), (2, 0.5, "b")]


def test_ordered_versions(spark):
    from corpuskit.operators import versions as VR
    v = spark.createDataFrame([("m", "1.10.0"), ("m", "1.2.0"), ("m", "1.2.0-rc.1")], "name string, version string")
    assert [r.version for r in VR.ordered_versions(v).collect()] == ["1.2.0-rc.1", "1.2.0", "1.10.0"]


def test_kernels_hold_the_results_of_a_piece():
    """A large batch gives its results in pieces, none of them lost, in order."""
    import pandas as pd

    from corpuskit.functions.kernels import PIECE_CHARS, PIECE_TEXTS, in_pieces
    texts = [None, ""] + ["x" * n for n in range(5000)] + ["y" * PIECE_CHARS] * 3
    pieces = list(in_pieces(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)]), lambda t: [t]))
    assert [x for p in pieces for x in p] == [[t] for t in texts]
    assert all(len(p) <= PIECE_TEXTS and sum(len(x[0] or "") for x in p[:-1]) < PIECE_CHARS for p in pieces)
