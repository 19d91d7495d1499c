import random

import numpy as np
import pytest
from brute import corpus, frame

from corpuskit.llm import passages as P


def test_tokens_name_shingles():
    texts = [b"", b"One two", b"a b c d e f", b"A  B\tc\nd e\x0bF", b"x " * 40, b" lead"]
    h, at = P.tokens(texts)
    assert np.diff(at).tolist() == [max(0, len(t.split()) - 4) for t in texts]
    names = {}
    for t, a, z in zip(texts, at, at[1:]):
        w = t.lower().split()
        for i, v in enumerate(h[a:z].tolist()):
            assert names.setdefault(tuple(w[i:i + 5]), v) == v
    assert len(set(names.values())) == len(names)


def test_compact_windows_group_all_subsequences():
    """Every subsequence of ``least`` tokens or more lies in one window: the one of its minimum."""
    r = np.random.default_rng(1)
    for n in (0, 3, 7, 40, 90):
        h, least = r.integers(0, 1 << 62, n).astype(np.uint64), 7
        place, v = P.centers(h, np.array([0, n]), least, 2)
        left, right = P.compact_windows(place, v, n)
        mixed = P._mixed(h, 3) & ~P._POS
        for i in range(n):
            for j in range(i + least - 1, n):
                c = min(range(i, j + 1), key=lambda x: (int(mixed[x]), x))
                held = [k for k in range(len(place)) if left[k] <= i <= place[k] <= j <= right[k]]
                assert [place[k] for k in held] == [c]


def test_ranges_near_centers():
    """Looked up around single centers, compact windows are the stack's, up to ``least`` tokens away."""
    r = np.random.default_rng(2)
    for n in (7, 30, 200):
        h, least = r.integers(0, 1 << 62, n).astype(np.uint64), 7
        h[n // 2:] = h[:n - n // 2]
        place, v = P.centers(h, np.array([0, n]), least, 1)
        left, right = P.compact_windows(place, v, n)
        at = np.arange(0, len(place), 2)
        l, r_ = P._near_ranges(place, v, at, least)
        assert np.maximum(l, 0).tolist() == np.maximum(left, place - least + 1)[at].tolist()
        assert np.minimum(r_, n - 1).tolist() == np.minimum(right, place + least - 1)[at].tolist()


def test_names_of_subsequences():
    """Every subsequence of ``least`` tokens has one name for each of ``JOINTS``, given by the smallest
    hashes of its functions."""
    r = np.random.default_rng(3)
    h, least = r.integers(0, 1 << 62, 60).astype(np.uint64), 7
    h[40:55] = h[10:25]
    at = np.array([0, 30, 33, 60])
    got = P.named_windows(h, at, least)
    assert len(got) == P.HASHES + len(P.JOINTS)
    for joint, (place, name) in zip(P.JOINTS, got[P.HASHES:]):
        tuples = []
        for a, z in zip(at, at[1:]):
            low = [tuple(min(range(i, i + least), key=lambda x: (int(P._mixed(h, k + 1)[x] & ~P._POS), x)) for k in joint) for i in range(a, z - least + 1)]
            tuples += [t for i, t in enumerate(low) if not i or t != low[i - 1]]
        assert place.tolist() == [t[0] for t in tuples]
        names = {}
        for t, v in zip(tuples, name.tolist()):
            assert names.setdefault(tuple(h[list(t)].tolist()), v) == v
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("sentences, edits", [(4, 1), (8, 2)])
def test_recall_of_edited_passages(spark, sentences, edits):
    """Passages of pooled sentences, of which each stands in earlier texts too, with changed words:
    0.9 of the pairs that brute force calls near-duplicates are linked (in one class)."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    say = lambda k: [word() for _ in range(k)]
    pool, runs = [say(14) for _ in range(40)], lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    rows, pairs = [(i, say(30) + s + say(30)) for i, s in enumerate(pool)], []
    for i in range(80):
        passage = [w for s in r.sample(pool, sentences) for w in s]
        edited = list(passage)
        for _ in range(edits):
            edited[r.randrange(len(edited))] = "changed"
        rows += [(500 + i, say(40) + passage + say(40)), (1000 + i, say(40) + edited + say(40))]
        a, b = runs(passage), runs(edited)
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(i)
    got = {g.doc_id: g.class_id for g in P.passage_classes(frame(spark, [(i, " ".join(t), None, None, 1) for i, t in rows])).collect()}
    found = [i for i in pairs if 1000 + i in got and got[1000 + i] in (got.get(500 + i), 500 + i)]
    assert len(pairs) >= 60 and len(found) >= 0.9 * len(pairs), (len(found), len(pairs))


def same_words(rows, least=50):
    """Words of each document that lie in a run of ``least`` words which a smaller id has too."""
    first, out = {}, {}
    docs = {r[0]: (r[1] or "").encode().lower().split() for r in rows if r[0] is not None}
    for i, w in sorted(docs.items()):
        for k in range(len(w) - least + 1):
            first.setdefault(tuple(w[k:k + least]), i)
    for i, w in docs.items():
        out[i] = {k + j for k in range(len(w) - least + 1) if first[tuple(w[k:k + least])] < i for j in range(least)}
    return docs, out


@pytest.mark.parametrize("clash", [False, True])
def test_passages(spark, clash):
    rows = corpus()
    docs, same = same_words(rows)
    got = P.passage_classes(frame(spark, rows, clash)).collect()
    covered = {i: set() for i in docs}
    runs = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    for g in got:
        if g.doc_id is None:
            continue
        assert g.like_id < g.doc_id and g.n_words >= 50 and g.class_id <= g.like_id
        a = runs(docs[g.doc_id][g.start_word:g.start_word + g.n_words])
        b = runs(docs[g.like_id][g.like_start:g.like_start + g.like_words])
        assert g.similarity == pytest.approx(len(a & b) / len(a | b)) and g.similarity >= 0.8
        covered[g.doc_id].update(range(g.start_word, g.start_word + g.n_words))
    for i, words in same.items():
        assert not words or len(words & covered[i]) >= 0.9 * len(words), i


def test_edited_passage_is_found(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(120)]
    edited = passage[:60] + ["changed"] + passage[60:]
    rows = [(1, " ".join([word() for _ in range(80)] + passage), None, None, 1), (2, " ".join(edited + [word() for _ in range(300)]), None, None, 1),
            (3, " ".join(word() for _ in range(400)), None, None, 1)]
    got = P.passages(frame(spark, rows)).collect()
    assert [(g.doc_id, g.like_id) for g in got] == [(2, 1)] and got[0].n_words >= 115


def test_edit_next_to_an_end():
    """A passage of the least length with a changed word near an end, between other words."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    say = lambda k: [word() for _ in range(k)]
    for n in (50, 52, 54):
        for i in (0, 1, 4, n - 5, n - 1):
            passage = say(n)
            edited = passage[:i] + ["changed"] + passage[i + 1:]
            (own, at), (other, _) = (P.tokens([" ".join(say(20) + x + say(20)).encode()]) for x in (edited, passage))
            got = P.verified(own, other, 46, 0.8)
            assert got, (n, i)
            for a, z, lo, hi, share in got:
                x, y = set(own[a:z].tolist()), set(other[lo:hi].tolist())
                assert z - a >= 46 and share == len(x & y) / len(x | y) >= 0.8
    own, other = (P.tokens([" ".join(say(20) + x + say(20)).encode()])[0] for x in [say(30)] * 2)
    assert P.verified(own, other, 46, 0.8) == []


def test_often_met_windows(spark, monkeypatch):
    rows = [(i, "shared " + " ".join(f"w{j}" for j in range(90)) + f" own{i}", None, None, 1) for i in range(60)]
    monkeypatch.setattr(P, "OFTEN", 4)
    got = P.passage_classes(frame(spark, rows).repartition(7)).collect()
    assert {g.doc_id for g in got} == set(range(1, 60)) and {g.class_id for g in got} == {0}


def pooled(seed, n):
    """Documents of pooled sentences, all in an earlier text of their own: document 1000 + i repeats a
    passage of 500 + i made of four of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    say = lambda k: " ".join(word() for _ in range(k))
    pool = [say(14) for _ in range(40)]
    rows = [(i, say(60) + " " + s + " " + say(60)) for i, s in enumerate(pool)]
    for i in range(n):
        passage = " ".join(r.sample(pool, 4))
        rows += [(500 + i, say(60) + " " + passage + " " + say(60)), (1000 + i, say(60) + " " + passage + " " + say(60))]
    return [(i, t, None, None, 1) for i, t in rows]


def test_passages_of_pooled_sentences(spark):
    """Each sentence stands in an unrelated earlier document, which most min-hashes name."""
    got = {(g.doc_id, g.like_id) for g in P.passages(frame(spark, pooled(1, 60))).collect()}
    assert [i for i in range(60) if (1000 + i, 500 + i) not in got] == []


def test_chain_of_versions(spark):
    """Each third version is like the second, which comes after a first one that it isn't like."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, n = [], 40
    for i in range(n):
        v1 = [word() for _ in range(70)]
        v2 = v1[:20] + ["second"] + v1[21:]
        v3 = v2[:50] + ["third"] + v2[51:]
        rows += [(k * 100 + i, " ".join([word() for _ in range(60)] + v + [word() for _ in range(60)]), None, None, 1) for k, v in enumerate((v1, v2, v3))]
    got = {(g.doc_id, g.like_id) for g in P.passages(frame(spark, rows)).collect()}
    assert all((100 + i, i) in got for i in range(n)) and all((200 + i, 100 + i) in got or (200 + i, i) in got for i in range(n))


@pytest.mark.parametrize("parts", [5, 20])
def test_earlier_texts_with_parts_of_a_passage(spark, parts):
    """Earlier documents have other parts of a passage, too short to be like it, and take most names:
    the copy with a changed word still meets the passage itself."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    say = lambda k: [word() for _ in range(k)]
    rows, n = [], 100
    for i in range(n):
        passage = say(50)
        for k in range(parts):
            at = r.randrange(16)
            rows.append((i * 100 + k, say(40) + passage[at:at + 35] + say(40)))
        edited = list(passage)
        edited[r.randrange(50)] = "changed"
        rows += [(100000 + i, say(40) + passage + say(40)), (200000 + i, say(40) + edited + say(40))]
    got = {(g.doc_id, g.like_id) for g in P.passages(frame(spark, [(i, " ".join(t), None, None, 1) for i, t in rows])).collect()}
    found = [i for i in range(n) if (200000 + i, 100000 + i) in got]
    assert len(found) >= (0.93 if parts == 5 else 0.8) * n, len(found)


def test_inner_places_of_periodic_runs():
    """Only true repeats count as a run: rows of one form with other values between them don't."""
    periodic = " ".join(["one two three four five six seven"] * 20).encode()
    form = " ".join(f"the price of an item is {i}" for i in range(20)).encode()
    for text, some in ((periodic, True), (form, False), (b"few words", False), (b"", False)):
        h, at = P.tokens([text])
        found = []
        for k in range(P.HASHES):
            place, v = P.centers(h, at, 46, k)
            found += P.inner(h, place, v, np.zeros(len(place), np.int64)).tolist()
        assert any(found) == some


def test_empty(spark):
    assert P.passage_classes(frame(spark, [])).count() == 0
    assert P.passages(frame(spark, [(None, None, None, None, None), (1, "few words", None, None, 1)] * 2)).count() == 0
