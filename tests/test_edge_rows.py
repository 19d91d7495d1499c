"""Edge rows every fixture should carry: NULL, empty, whitespace-only, accented and non-Latin
text, duplicate keys with different payloads, equal timestamps, one-row and zero-row groups."""

import datetime as dt

from pyspark.sql import functions as F

from corpuskit.functions import text as TX
from corpuskit.operators import evaluation as M
from corpuskit.operators import relate as J
from corpuskit.operators import stats as A
from corpuskit.operators import text as D
from corpuskit.streaming import folds as T

EDGE = [(1, None, "x"), (2, "", ""), (3, "   \n\t ", "y"), (4, "L'été déjà vu", "Ça va"), (5, "東京 タワー", "日本"),
        (6, "dup", "first"), (7, "dup", "second")]


def _edge(spark):
    return spark.createDataFrame(EDGE, "id long, input string, output string")


def test_text_functions_on_edges(spark):
    r = {x.id: x for x in _edge(spark).select("id", TX.metric_tokens("input").alias("t"), TX.word_count("input").alias("n"),
                                               TX.normalize_answer("input").alias("na")).collect()}
    assert r[1].t == [] and r[1].n == 0 and r[2].t == [] and r[3].n == 0
    assert r[4].t == ["l'été", "déjà", "vu"] and r[4].n == 3  # Unicode word characters kept
    assert r[5].t == ["東京", "タワー"]


def test_metrics_on_edges(spark):
    d = _edge(spark).select("id", F.col("input").alias("prediction"), F.col("output").alias("reference"))
    b = M.bleu(d).first()
    assert 0.0 <= b.bleu <= 1.0
    rg = {x.rouge_type: x for x in M.rouge(d).collect()}
    assert set(rg) == {"rouge1", "rouge2", "rougeL"}
    em = M.exact_match(d).first()
    assert em.total == 7
    empty = d.limit(0)
    assert M.bleu(empty).first().bleu == 0.0 and M.accuracy(empty).first().accuracy == 0.0


def test_dedup_and_stats_on_edges(spark):
    d = _edge(spark)
    out = {r.id for r in J.dedup(d, "id").collect()}
    assert 6 in out and 7 not in out and 1 in out  # NULL key kept once, first duplicate wins
    s = A.dataset_summary(d).first()
    assert s.n_records == 7
    assert A.quality_checks(d).first().total == 7


def test_chunking_and_html_on_edges(spark):
    d = _edge(spark).withColumnRenamed("input", "text")
    c = D.chunk_documents(d, "id", "text", "index", 100, 10)
    assert {r.doc_id for r in c.collect()} == {4, 5, 6, 7}  # NULL, empty and blank texts give no chunks
    h = D.html_text(spark.createDataFrame([(1, None), (2, ""), (3, "<p>é &amp; 東京</p>")], "page_id long, html string"))
    got = {r.page_id: r.text for r in h.collect()}
    assert got == {1: "", 2: "", 3: "é & 東京"}


def test_limiter_equal_timestamps(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t, 3), (1, t, 1), (1, t, 2), (2, t, 9)], "user_id long, ts timestamp, event_id long")
    r = {x.seq: x.allowed for x in T.sliding_log_limit(ev, "user_id", "ts", "event_id", 2, 60).collect()}
    assert r == {1: True, 2: True, 3: False, 9: True}  # equal times ordered by id
