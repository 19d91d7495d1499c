import random

import pytest
from brute import WORDS, corpus, frame

from corpuskit.llm import quality as Q


def slow_counts(t):
    t = t or ""
    w = WORDS.findall(t)
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    rep = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep))


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b a b a b a", "x\nx\n y\n\nx", "# *$%&|<> é  ß", "\x85 a\x0bb", "De " * 300,
                                  "one two three one two three four one two three"])
def test_counts(text):
    assert Q.text_counts(text)[:5] == slow_counts(text)


@pytest.mark.parametrize("clash", [False, True])
def test_scored(spark, clash):
    rows = corpus()
    got = Q.scored(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    want = {r[0]: slow_counts(r[1]) for r in rows if r[0] is not None}
    for g in got:
        if g.doc_id is not None:
            n, c, s, d, p = want[g.doc_id]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, c, s, d, p)
            assert g.base_failed == (n < 50 or 100 * p > 50 * n) and (not g.kept or not g.base_failed)


def test_good_documents_keep_columns(spark):
    rows = corpus()
    df = frame(spark, rows, True)
    kept = Q.good_documents(df)
    assert kept.columns == df.columns
    scores = sorted(r.doc_id for r in Q.scored(df).filter("kept").collect() if r.doc_id is not None)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == scores
    assert Q.good_documents(frame(spark, [])).count() == 0 and Q.scored(frame(spark, [])).count() == 0


def test_model_finds_planted_accuracies():
    """Votes drawn from known tables: the fit comes near them, and its posterior separates."""
    r = random.Random(3)
    tables = [((0.7, 0.2, 0.1), (0.02, 0.18, 0.8)), ((0.5, 0.1, 0.4), (0.01, 0.19, 0.8)), ((0.8, 0.1, 0.1), (0.05, 0.05, 0.9))]
    counted, truth = {}, {}
    for _ in range(20000):
        good = r.random() < 0.85
        code = sum(r.choices(range(3), t[good])[0] * 3 ** i for i, t in enumerate(tables))
        counted[code] = counted.get(code, 0) + 1
        truth.setdefault(code, [0, 0])[good] += 1
    m = Q.fit(counted, 3)
    assert abs(m.prior - 0.85) < 0.03
    for got, want in zip(m.votes, tables):
        for g, w in zip(got, want):
            assert all(abs(a - b) < 0.06 for a, b in zip(g, w))
    assert all(a > 0.8 for a in m.accuracy())


def test_model_without_votes_is_the_guess():
    m = Q.fit({}, 2)
    assert m.prior == 0.85 and m.votes[0] == Q.GUESS


def test_labels(spark, sf):
    """Held against the labels of the tables: junk goes, clean documents stay."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["label"], r["kept"]) for r in Q.scored(d).drop("quality").join(
        spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").filter("not base_failed").collect()]
    good = [k for label, k in rows if label == 1]
    bad = [k for label, k in rows if label == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
