import zlib
from collections import Counter

import numpy as np
import pytest
from brute import corpus, frame

from corpuskit.llm import langid as L


def slow_counts(text):
    text = text.lower()
    words = "".join(c if c.isalpha() else "\0" for c in text).split("\0")
    flat = "\0" + "".join(w + "\0" for w in words if w)
    out = Counter()
    for n in L.GRAMS:
        for i in range(len(flat) - n + 1):
            h = n
            for c in flat[i:i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 29
            out[h % L.DIM] += 1
    return out


@pytest.mark.parametrize("text", ["a", "Hello, wörld! 123", "日本語 テキスト", "x" * 50, "😀 𝒜𝒷 c", "one\ntwo  three"])
def test_gram_counts(text):
    assert {i: int(n) for i, n in enumerate(L.gram_counts(text)) if n} == dict(slow_counts(text))


def test_steps_of_long_texts(monkeypatch):
    text = "the quick brown fox " * 50
    whole = L.gram_counts(text)
    monkeypatch.setattr(L, "STEP", 37)
    assert np.array_equal(L.gram_counts(text), whole)


@pytest.mark.parametrize("text", [None, "", "123 ...", "\n"])
def test_no_letters(text):
    assert L.gram_counts(text) is None


def test_centroids_of_clusters():
    r = np.random.default_rng(0)
    v = np.concatenate([np.abs(r.normal(0, 0.05, (30, 20)) + np.eye(20)[k]) for k in (0, 5, 9)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centers, own = L.spherical_kmeans(v, 3)
    assert len({tuple(own[i:i + 30]) for i in (0, 30, 60)}) == 3 and all(len(set(own[i:i + 30])) == 1 for i in (0, 30, 60))
    assert np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert len(L.spherical_kmeans(v[:2], 4)[0]) == 2


def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = L.held_out_languages(d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    from pyspark.sql import functions as F
    d = spark.read.parquet(f"{sf}/documents.parquet")
    wrong = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, L.held_out_languages(d).collect())) == sorted(map(key, L.held_out_languages(wrong).collect()))


@pytest.mark.parametrize("clash", [False, True])
def test_edges(spark, clash):
    rows = corpus()
    got = L.held_out_languages(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    known = {r[2] for r in rows if r[2]}
    by = {r[0]: r[1] for r in rows}
    for g in got:
        none = not any(c.isalpha() for c in by[g.doc_id] or "") if g.doc_id is not None else None
        assert g.lang_pred in known | {"und"} and (none is None or (g.lang_pred == "und") == none)
    assert L.held_out_languages(frame(spark, [])).count() == 0
    assert L.held_out_languages(frame(spark, [(1, "text", None, None, 4)])).first()["lang_pred"] == "und"


def test_rejection():
    v = np.zeros(L.DIM)
    m = L.Model(np.ones(L.DIM), np.array([v + np.eye(L.DIM)[3]]), ["en"], np.array([0.2]))
    assert m.predict("far away")[2]
