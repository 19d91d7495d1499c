import hashlib
import random

import pytest
from brute import corpus, frame

from corpuskit.llm import suffix_repeats as S


def slow(rows, least=50):
    """By position: the smallest id with the window."""
    big = 1 << 62
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            w = b[k:k + least]
            first[w] = min(first.get(w, big), big if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - least + 1):
            if first[b[k:k + least]] < (big if i is None else i):
                gone[k:k + least] = [True] * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("clash", [False, True])
def test_keep_first_copies(spark, clash):
    rows = corpus()
    got = [tuple(r) for r in S.keep_first_copies(frame(spark, rows, clash)).collect()]
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


@pytest.mark.parametrize(("often", "hot"), [(2, 50_000), (16, 0), (2, 1)])
def test_often_and_hot_anchors(spark, monkeypatch, often, hot):
    """Anchors taken as shared at once, and anchors settled per window, give the same result."""
    rows = corpus(40, 3)
    monkeypatch.setattr(S, "OFTEN", often)
    plain = S.removals
    monkeypatch.setattr(S, "removals", lambda docs, n=50: plain(docs, n, S.GRAM, hot))
    got = [tuple(r) for r in S.keep_first_copies(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    rows = corpus(32, 5)
    got = [tuple(r) for r in S.keep_first_copies(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_empty(spark):
    assert S.keep_first_copies(frame(spark, [])).count() == 0
    assert S.without_repeats(frame(spark, [])).count() == 0
    assert S.repeat_groups(frame(spark, [])).count() == 0


def test_without_repeats(spark):
    rows = corpus()
    df = frame(spark, rows, True)
    got = S.without_repeats(df)
    assert got.columns == df.columns and got.count() == len(rows)
    lost = {r[0]: r[1] - r[2] for r in slow(rows)}
    for r in got.collect():
        if r.doc_id is not None and r.text is not None:
            assert abs(len(r.text.encode()) - lost[r.doc_id]) <= 6  # a cut character goes as a whole
            assert r.n_chars == len(r.text) or lost[r.doc_id] == len(r.text.encode())


def test_suffix_array_and_intervals():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 14))) for _ in range(12)]
    owner, offset, _, lcp = S.suffix_array(texts, 5)
    tails = [texts[o][k:] for o, k in zip(owner, offset)]
    assert tails == sorted(tails) and len(tails) == sum(len(t) - 4 for t in texts)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(tails, tails[1:])]
    # every right-maximal string of 5 bytes or more is one interval with all of its occurrences
    want = set()
    for i, a in enumerate(tails):
        for b in tails[:i]:
            n = common(a, b)
            if n >= 5:
                want.add((n, frozenset(k for k, t in enumerate(tails) if t[:n] == a[:n])))
    got = {(d, frozenset(range(i, j + 1))) for d, i, j in S.lcp_intervals(lcp.tolist(), 5)}
    assert got == want


def test_repeat_groups(spark):
    """A shared passage shows up with all its documents; groups name equal bytes."""
    rows = corpus(40, 3)
    texts = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    groups = {}
    for g in S.repeat_groups(frame(spark, rows)).collect():
        if g.doc_id is not None:
            groups.setdefault((bytes(g.repeat), g.length), []).append((g.doc_id, texts[g.doc_id][g.start:g.start + g.length]))
    assert groups
    for (_, length), members in groups.items():
        assert len({b for _, b in members}) == 1 and len(members[0][1]) == length >= 50
        assert {i for i, _ in members} == {i for i, t in texts.items() if members[0][1] in t}


def test_parameters(spark):
    with pytest.raises(ValueError):
        S.removals(frame(spark, []), 10, 20)


def test_only_windows_met_twice_are_sorted(monkeypatch):
    """Strings of one anchor mostly differ; before, each of their suffixes was sorted."""
    import random
    r = random.Random(4)
    say = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    same = say(14)
    texts = [say(30) + b"anchor" + say(30) for _ in range(40)] + [say(9) + same + say(9), same + say(20), say(20) + same]
    whole, sizes = S.suffix_array, []

    def seen(strings, least, some=None):
        got = whole(strings, least, some)
        sizes.append(len(got[0]))
        return got

    monkeypatch.setattr(S, "suffix_array", seen)
    told = lambda: sorted((d, sorted(zip(o.tolist(), k.tolist()))) for d, o, k in S.maximal_repeats_of(texts, 10))
    found = told()
    assert found == [(14, [(40, 9), (41, 0), (42, 20)])] and sizes == [15]
