import hashlib
import re

import pytest
from brute import corpus, frame
from pyspark.sql import functions as F

from corpuskit.llm import fingerprint as P


def paragraphs(t):
    return {x.strip(" ") for x in re.findall(r"[^\n]{1,160}[^\n.!?]*[.!?]*", t or "")} - {""}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("clash", [False, True])
def test_compared(spark, clash):
    rows = [r for r in corpus() if r[0] is not None]
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in P.compared(frame(spark, rows, clash)).collect()}
    seen = {}
    for i, r in enumerate(rows):
        t, nxt, g = r[1] or "", rows[(i + 1) % len(rows)][1] or "", got[r[0]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == pytest.approx(likeness(paragraphs(t), paragraphs(edited)))
        assert g.near_next == pytest.approx(likeness(paragraphs(t), paragraphs(nxt)))
        assert seen.setdefault(t, g.fingerprint) == g.fingerprint
        assert seen.setdefault(edited, g.edited_fingerprint) == g.edited_fingerprint
    assert len({f for f in seen.values()}) > len(rows) // 2


def test_order_of_null_and_repeated_ids(spark):
    rows = corpus()
    got = P.with_next(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    known = sorted((r for r in got if r.doc_id is not None), key=lambda r: -r.doc_id)
    texts = {r[0]: r[1] or "" for r in rows}
    for a, b in zip(known, known[1:]):
        if a.doc_id != b.doc_id:
            assert a.next_text in (texts[b.doc_id], texts[a.doc_id])
    # every text is the next one of as many rows as have it
    assert sorted(r.next_text for r in got) == sorted(r.text for r in got)


def test_runs(spark, monkeypatch):
    """Many short runs and gaps between ids give the same order as one run."""
    ids = [i * i % 9973 for i in range(300)]
    rows = [(i, f"text {i}", None, None, 1) for i in ids]
    order = sorted(set(ids), reverse=True)
    want = {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    for run in (1, 7, 2000):
        monkeypatch.setattr(P, "RUN", run)
        got = {r.doc_id: r.next_text for r in P.with_next(frame(spark, [(i, f"text {i}", None, None, 1) for i in order])).collect()}
        assert got == want
    assert rows


def test_small_tables(spark):
    assert P.compared(frame(spark, [])).count() == 0
    r = P.compared(frame(spark, [(5, "one line", None, None, 8)])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"one one ").hexdigest()
    r = P.compared(frame(spark, [(None, None, None, None, None)])).first()
    assert (r.n_chars, r.near_edited, r.near_next) == (0, 1.0, 1.0)


def test_difference_is_recovered(spark):
    """Sketches of sets of many sizes give back the exact difference with its sides."""
    sizes = [(0, 0, 0), (1, 0, 0), (0, 3, 2), (5, 5, 50), (40, 60, 3), (300, 200, 100)]
    rows = [(i, list(range(a)) + list(range(10**6, 10**6 + c)), list(range(5000, 5000 + b)) + list(range(10**6, 10**6 + c)))
            for i, (a, b, c) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    for r in df.select("*", P.difference(F.col("a"), F.col("b")).alias("d")).collect():
        assert {(x.k, x.s) for x in r.d} == {(k, 1) for k in set(r.a) - set(r.b)} | {(k, -1) for k in set(r.b) - set(r.a)}
    # the first table is too small for these, and says so
    small = df.filter("i >= 3").select(P.peeled(P.subtracted(P.table(P.signed(F.col("a")), F.lit(4)), P.table(P.signed(F.col("b")), F.lit(4))), F.lit(4)).alias("p"))
    assert not any(r.p.done for r in small.filter("size(p.items) >= 0").collect()[1:])
