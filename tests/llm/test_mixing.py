import itertools

import pytest
from brute import WORDS, corpus, frame
from pyspark.sql import functions as F

from corpuskit.llm import mixing as M


def filled(sizes, weights, share, most):
    """Share by weight, stop at the caps, reshare the excess, until none is above."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not above:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in above:
            target[i] = most * sizes[i]
            open_.discard(i)
        left = share * sum(sizes) - sum(t for i, t in enumerate(target) if i not in open_)
    return target


@pytest.mark.parametrize("sizes", [[], [0], [0, 0], [5], [100, 1, 1], [10, 20, 30, 40], [1000, 3, 0, 5, 7, 9], [1] * 50])
def test_water_filled(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert M.water_filled(sizes, weights, 1.5, 2) == pytest.approx(filled(sizes, weights, 1.5, 2))


def test_flow_is_least_cost():
    """Against all flows of a small network (words in steps of one)."""
    capacity = {("a",): 2, ("a", "b"): 3, ("b",): 1}
    quota = {"a": 6, "b": 4}
    got = M.min_cost_flow(capacity, quota, 2)
    arcs = [(p, s) for p in capacity for s in p]
    cost = lambda p, n: sum(1 if i < capacity[p] else 3 for i in range(n))
    best = None
    for f in itertools.product(*[range(2 * capacity[p] + 1) for p, _ in arcs]):
        flow = dict(zip(arcs, f))
        out = {p: sum(flow[p, s] for s in p) for p in capacity}
        into = {s: sum(flow[a] for a in arcs if a[1] == s) for s in quota}
        if all(out[p] <= 2 * capacity[p] for p in capacity) and all(into[s] <= quota[s] for s in quota):
            value = (-sum(f), sum(cost(p, out[p]) for p in capacity))
            best = value if best is None else min(best, value)
    out = {p: sum(n for (q, _), n in got.items() if q == p) for p in capacity}
    assert (-sum(got.values()), sum(cost(p, out[p]) for p in capacity)) == best
    assert M.min_cost_flow({}, {}, 2) == {} and M.min_cost_flow({("a",): 0}, {"a": 3}, 2) == {}


@pytest.mark.parametrize("clash", [False, True])
def test_mix_sources(spark, clash):
    rows = corpus()
    got = M.mix_sources(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORDS.findall(t or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    want = dict(zip(names, filled([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    largest = max(size(r[1]) for r in rows)
    for s in names:
        mine = [g for g in got if g.whole.source == s]
        assert all(g.source_size == total[s] and g.target == pytest.approx(want[s]) and 0 <= g.copies <= 2 for g in mine)
        assert abs(sum(g.copies * g.size for g in mine) - want[s]) <= largest / 2 + 1
    again = M.mix_sources(frame(spark, rows, clash).repartition(5)).collect()
    key = lambda g: (g.doc_id is None, g.doc_id or 0, g.size, g.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_overlapping_sources(spark):
    """A document of two sources serves either; nothing is taken above the quotas by more than a row."""
    rows = [(i, "w " * 10, ["a"] if i < 10 else ["a", "b"] if i < 30 else ["b"]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = M.mix(df, F.col("sources"), lambda c: {"a": 250, "b": 150}, 2).collect()
    assert sum(g.copies * g.size for g in got) == 400 and {g.copies for g in got} == {1}


def test_empty_and_digits(spark):
    assert M.mix_sources(frame(spark, [])).count() == 0
    assert M.mix_sources(frame(spark, [(1, None, None, None, None)])).first()["copies"] == 0
    sized = spark.createDataFrame([(["a"], f"{i:04x}", 3) for i in range(0, 4096, 7)], "pattern array<string>, key string, size long")
    for rest in (1, 2, 500, 1000, 1755):
        share = spark.createDataFrame([(["a"], rest)], "pattern array<string>, rest long")
        for digits in (1, 2, 3):
            until = M.thresholds(sized, share, digits).first()["until"]
            taken = sum(3 for i in range(0, 4096, 7) if f"{i:04x}" < until)
            assert abs(taken - rest) <= 1.5
