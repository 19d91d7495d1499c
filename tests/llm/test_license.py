import random

import pytest
import regex
from brute import corpus, frame

from corpuskit.llm import license_scan as S


def slow(rows, templates, contained=S.CONTAINED, k=S.SHINGLE):
    """Every window against every template."""
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    runs = lambda w: [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for lic, text in templates:
        tw = words(text)
        if len(tw) < k:
            continue
        own = set(runs(tw))
        n = max(S.LEAST, 1 << (len(tw) - 1).bit_length())
        for i, t, *_ in rows:
            sh = runs(words(t))
            for w in range(max(len(sh), 1) // n + 1):
                share = len(own & set(sh[w * n:w * n + 2 * n - k + 1])) / len(own)
                if share >= contained:
                    best, wins = out.get((i, lic), (0, set()))
                    out[i, lic] = (max(best, share), wins | {(n, w)})
    return {k: (v[0], len(v[1])) for k, v in out.items()}


def planted(seed=5):
    r, rows = random.Random(seed), corpus(40, 4)
    out = []
    for i, t, *rest in rows:
        if t and i is not None and i % 2 == 0:
            w = t.split(" ")
            lic = r.choice(S.TEMPLATES)[1].split(" ")
            if r.random() < 0.4:
                lic[r.randrange(len(lic))] = "altered"
            at = r.randrange(len(w) + 1)
            t = " ".join(w[:at] + lic + w[at:])
        out.append((i, t, *rest))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_scanned(spark, clash):
    rows = planted()
    got = {(r.doc_id, r.license): (pytest.approx(r.containment), r.n_windows) for r in S.scanned(frame(spark, rows, clash)).collect()}
    want = slow(rows, S.TEMPLATES)
    assert want and want == got


def test_every_template_is_found_anywhere(spark):
    rows = [(len(S.TEMPLATES) * p + j, "x " * p + text + " y" * 40, None, None, 1) for p in range(0, 70, 9) for j, (_, text) in enumerate(S.TEMPLATES)]
    got = {r.doc_id for r in S.scanned(frame(spark, rows)).filter("containment = 1").collect()}
    assert got == {r[0] for r in rows}


def test_empty_and_no_templates(spark):
    assert S.scanned(frame(spark, [])).count() == 0
    assert S.scanned(frame(spark, corpus()), templates=[("x", "too short")]).count() == 0
    assert S.scanned(frame(spark, [(1, None, None, None, None), (None, "", None, None, 0)])).count() == 0


def test_bands_guarantee():
    for size in (8, 16, 32, 64):
        n = S.bands_for(size)
        short = (size // 2 + 1 if size > 8 else 5) - 4
        shared = -(-4 * short // 5)
        similar = shared / (2 * size - 4 + short - shared)
        assert (1 - similar) ** n <= S.MISS
