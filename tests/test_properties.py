"""Property tests on generated inputs."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.functions.chunking import chunk_text
from corpuskit.functions.kernels import lcs_length

ALPHABET = string.ascii_letters + "   ..!?\n"


def _spans(text, profile, size, overlap):
    """Re-derive the (start, end) spans the chunker walks, to check coverage."""
    from corpuskit.functions.chunking import PROFILES
    p = PROFILES[profile]
    if profile == "knowledge":
        text = text.strip()
        if len(text) <= size:
            return text, [(0, len(text))]
    spans, start, n, half = [], 0, len(text), size // 2
    while start < n:
        end = start + size
        if end < n:
            w = text[start:end]
            if profile == "index":
                for sep in p["seps"]:
                    i = w.rfind(sep)
                    if i > half:
                        end = start + i + len(sep)
                        break
            else:
                i = w.rfind(p["para"])
                if i > half:
                    end = start + i + (2 if profile == "knowledge" else 0)
                else:
                    for sep in p["seps"]:
                        i = w.rfind(sep)
                        if i > half:
                            end = start + i + (len(sep) if profile == "knowledge" else 1)
                            break
        spans.append((start, min(end, n)))
        start = end - overlap
    return text, spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=0, max_size=900), st.sampled_from(["index", "knowledge", "tutorial"]))
def test_chunks_recover_the_text(text, profile):
    size, overlap = 120, 20
    chunks = chunk_text(text, profile, size, overlap)
    t, spans = _spans(text, profile, size, overlap)
    covered = [False] * len(t)
    for a, b in spans:
        for i in range(a, b):
            covered[i] = True
    assert all(covered)  # every character lies in some chunk span
    # every non-blank chunk is a stripped slice of the text, and no chunk exceeds the size
    for c in chunks:
        assert len(c) <= size and (c == "" or c in t)
    # order is kept: chunks start at non-decreasing offsets
    pos = [t.find(c) for c in chunks if c]
    assert pos == sorted(pos)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcde"), max_size=25))
def test_lcs_symmetric_and_bounded(a, b):
    n = lcs_length(a, b)
    assert n == lcs_length(b, a) and n <= min(len(a), len(b))


def test_dedup_idempotent_and_topk_sorted(spark):
    from corpuskit.operators import relate as J
    from corpuskit.operators import search as V
    d = spark.createDataFrame([(i, f" Text {i % 7} ") for i in range(50)], "seq long, input string")
    once = J.dedup(d, "seq")
    twice = J.dedup(once, "seq")
    assert sorted(tuple(r) for r in once.collect()) == sorted(tuple(r) for r in twice.collect())
    c = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    for qid, rows in ((k, [r for r in V.vector_topk(c, q, 6).collect() if r.query_id == k]) for k in (1, 2)):
        rows = sorted(rows, key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 7))
        assert all((a.score, -a.doc_id) >= (b.score, -b.doc_id) for a, b in zip(rows, rows[1:]))
