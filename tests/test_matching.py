import difflib
import random
import re

import numpy as np
import pytest

from corpuskit.functions import sequence as Q
from corpuskit.operators import matching as MT

WORD = re.compile(r"\w+")
WORDS = "reset password account billing invoice refund login error network printer setup install update".split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def best(q, kb, mode):
    """Every entry that shares a keyword, scored one by one."""
    ql = q.lower().strip()
    qw, found = set(WORD.findall(ql)), []
    for i, t in enumerate(kb):
        tl = t.lower().strip()
        tw = set(WORD.findall(tl))
        if any(len(w) > 3 for w in qw & tw):
            like = 1 - edits(ql, tl) / max(len(ql), len(tl), 1)
            found.append((0.7 * like + 0.3 * len(qw & tw) / len(qw) if mode == "keyword" else like, -i))
    return (-max(found)[1], max(found)[0]) if found else None


def test_match_equals_brute_force(spark):
    r = random.Random(11)
    kb = [" ".join(r.choice(WORDS) for _ in range(r.randint(2, 6))) + "?" for _ in range(25)]
    qs = [" ".join(r.choice([*WORDS, "how", "do", "i", "my"]) for _ in range(r.randint(1, 7))) for _ in range(40)] + ["zzz qq", "", "x", None]
    kdf = spark.createDataFrame([*enumerate(kb), (99, None)], "o long, t string")
    qdf = spark.createDataFrame(list(enumerate(qs)), "qid long, q string")
    for mode in ("ratio", "keyword"):
        got = {r.qid: (r.kb_order, r.score) for r in MT.match(qdf, kdf, "qid", "q", "o", "t", mode).collect()}
        for i, q in enumerate(qs):
            want = best(q or "", kb, mode)
            assert (want is None) == (i not in got)
            if want:
                assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-12, (mode, q)


def test_best_answers_thresholds(spark):
    kdf = spark.createDataFrame([(0, "How do I reset my password?", "Use the reset link.")], "o long, t string, a string")
    qdf = spark.createDataFrame([(1, "how do i reset my password"), (2, "completely unrelated text here"), (3, None)], "qid long, q string")
    r = {x.qid: x for x in MT.best_answers(qdf, kdf, "qid", "q", "o", "t", "a", "simple").collect()}
    assert r[1].found and r[1].answer == "Use the reset link." and not r[2].found and not r[3].found and len(r) == 3


# ------------------------------------------------------------------ sequence ratio

def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def recipe(q, kb, profile):
    """(entry, score) of one question, entry by entry."""
    prepared = (lambda t: (t or "").lower().strip()) if profile == "simple" else lambda t: (t or "").lower()
    q, best, score = prepared(q), None, 0
    some = range(len(kb))
    words = lambda t: set(re.findall(r"\b\w+\b", t))
    if profile == "keyword":
        some = [i for i, t in enumerate(kb) if any(len(w) > 3 for w in words(q) & words(prepared(t)))] or some
    for i in some:
        s = ratio(q, prepared(kb[i]))
        if profile == "keyword":
            s = s * 0.7 + len(words(q) & words(prepared(kb[i]))) / max(len(words(q)), 1) * 0.3
        if s > score:
            best, score = i, s
    return best, score


@pytest.mark.parametrize("low, high, letters", [(0, 25, "ab"), (0, 60, "abc é😀"), (150, 420, "abcdefghij  éñ😀xyzqwertuiop"), (190, 230, "aaaaab cdef")])
def test_ratios_equal_the_library(low, high, letters):
    r = random.Random(low + high)
    some = lambda n: ["".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)]
    a, b = some(12) + ["", "x"], some(12) + ["", "x", "a" * 300]
    b.append(a[0] + "tail")
    alphabet = Q.alphabet(a, b)
    x, y = Q.Texts(a, alphabet), Q.Texts(b, alphabet)
    i, j = (g.ravel() for g in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))
    got, bound = Q.ratios(x, y, i, j), Q.upper_bounds(x, y)
    for p, q, s in zip(i, j, got):
        assert s == ratio(a[p], b[q]) and bound[p, q] >= s, (a[p], b[q])


def test_lengths_that_can_reach_a_ratio():
    for t in (0.1, 0.4, 0.5, 0.9):
        for n in range(0, 300, 7):
            reach = MT._reach(MT._length_class(n), t, MT.CLASSES)
            assert all(MT._length_class(m) in reach for m in range(0, 3000, 3) if 2 * min(n, m) >= t * (n + m))


def _faq_tables(spark, seed=11):
    r = random.Random(seed)
    kb = [" ".join(r.choice(WORDS) for _ in range(r.randint(2, 6))) + "?" for _ in range(40)] + [None, "", "how", " ".join(WORDS * 4)]
    qs = [" ".join(r.choice([*WORDS, "how", "do", "i", "my"]) for _ in range(r.randint(1, 7))) for _ in range(60)]
    qs += ["zzz qq", "", "x", None, "  HOW  ", kb[3], kb[3].upper(), "reset " * 60, "how do i my"]
    return (kb, qs, spark.createDataFrame(list(enumerate(kb)), "o long, t string").withColumn("a", MT.F.concat(MT.F.lit("to "), "o")),
            spark.createDataFrame(list(enumerate(qs)), "qid long, q string").repartition(3))


@pytest.mark.parametrize("profile", ["simple", "train", "keyword"])
def test_sequence_match_equals_the_recipe(spark, profile, monkeypatch):
    kb, qs, kdf, qdf = _faq_tables(spark)
    want = {i: recipe(q, kb, profile) for i, q in enumerate(qs)}
    for size in (3, 64):
        monkeypatch.setattr(MT, "QUESTIONS", size)
        monkeypatch.setattr(MT, "ENTRIES", size)
        got = {r.qid: (r.kb_order, r.score) for r in MT.sequence_match(qdf, kdf, "qid", "q", "o", "t", profile).collect()}
        for i, (entry, score) in want.items():
            assert got.get(i, (None, 0)) == (entry, pytest.approx(score, abs=1e-12)), (qs[i], profile)
    least, equal = (0.4, True) if profile == "simple" else (0.5, False) if profile == "train" else (0.4, False)
    for r in MT.best_answers(qdf, kdf, "qid", "q", "o", "t", "a", profile, "sequence").collect():
        entry, score = want[r.qid]
        found = score >= least if equal else score > least
        assert (r.found, r.matched) == (found, entry if found else None)
        assert (r.answer == f"to {entry}") == found and r.confidence == pytest.approx(score if found else 0)


def test_sequence_match_without_rows(spark):
    kb, qs, kdf, qdf = _faq_tables(spark)
    assert MT.sequence_match(qdf.filter("false"), kdf, "qid", "q", "o", "t").count() == 0
    assert MT.sequence_match(qdf, kdf.filter("false"), "qid", "q", "o", "t", "keyword").count() == 0


@pytest.mark.parametrize("masks", [1 << 20, 50])
def test_edit_distances(monkeypatch, masks):
    """Distances of many pairs at once equal the table's, over word ends, empty texts and any letters."""
    r = random.Random(1)
    say = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    a = ["", "a", "é" * 64, "ab" * 32, "x" * 65] + [say("abcdé😀", n) for n in (1, 5, 63, 64, 65, 127, 128, 130, 200)]
    b = ["", "b", "é" * 63, "abc" * 40] + [say("abcdéq", r.randint(1, 200)) for _ in range(6)] + a[8:12]
    i, j = (np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)))
    monkeypatch.setattr(Q, "MASKS", masks)
    assert Q.edit_distances(a, b, i, j).tolist() == [edits(a[x], b[y]) for x, y in zip(i, j)]


@pytest.mark.parametrize("limits", [(1 << 16, 1 << 20, 1 << 20), (50, 1 << 20, 1 << 20), (1 << 10, 700, 1 << 20), (100, 300, 60)])
def test_ratios_by_bits_and_by_table(monkeypatch, limits):
    """Runs over word ends, empty texts and texts too large for bits: ratios equal the library's."""
    for name, limit in zip(("CELL_WORDS", "MOST_WORDS", "MASKS"), limits):
        monkeypatch.setattr(Q, name, limit)
    r = random.Random(5)
    for low, high, letters in [(0, 3, "ab"), (0, 90, "abc é😀"), (120, 330, "abcdefghij  éñ😀xyz")]:
        some = lambda n: ["".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)]
        a, b = ["", "x", "ab", *some(6)], ["", "x", "a" * 64, "ab" * 64, *some(6)]
        a, b = a + ["zz" + b[6], b[7] * 2], b + [a[5] + "tail", a[6]]
        letters_of = Q.alphabet(a, b)
        x, y = Q.Texts(a, letters_of), Q.Texts(b, letters_of)
        i, j = (g.ravel() for g in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))
        assert Q.ratios(x, y, i, j).tolist() == [ratio(a[p], b[q]) for p, q in zip(i, j)]


def test_pairs_that_cannot_win_are_given_up():
    """Only the best entries of a question are scored whole; before, every pair's rectangles were searched to the end."""
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    a, b = [say(r.randint(5, 12)) for _ in range(12)], [say(r.randint(2, 25)) for _ in range(60)]
    letters = Q.alphabet(a, b)
    x, y = Q.Texts(a, letters), Q.Texts(b, letters)
    i, j = (g.ravel() for g in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))
    want, extra = Q.ratios(x, y, i, j), np.array([r.random() * 0.3 for _ in i])
    for full, scale, more, least in ((want, 1.0, 0.0, 0.0), (want * 0.7 + extra, 0.7, extra, 0.4)):
        got = MT._scores(Q.Matching(x, y, i, j), scale, more, least).reshape(len(a), len(b))
        full = full.reshape(got.shape)
        top = full.max(axis=1, keepdims=True)
        assert ((got == top) == (full == top))[top[:, 0] >= least].all() and (got[top[:, 0] < least] < least).all()
        assert (got < 0).sum() > got.size / 4
