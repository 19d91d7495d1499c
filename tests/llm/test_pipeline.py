import public_tokenizers
import pytest
from brute import components, corpus, frame
from tokenizers import Tokenizer as Library

import corpus_pipeline as C
from corpuskit.llm import mixing, quality
from corpuskit.llm.components import connected_components


def test_stages():
    assert [f.__name__ for _, f in C.STAGES] == ["quality_rules", "near_dedup", "repeated_passages", "source_mix", "bpe_tokens"]


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, clash=False):
        path = str(tmp_path / "t")
        frame(spark, rows, clash).write.parquet(f"{path}/documents.parquet")
        return path
    return write


@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, tables, clash):
    """Stage by stage on what the one before kept."""
    from test_simhash import slow_fp
    from test_suffix_repeats import slow
    rows = corpus()
    sf = tables(rows, clash)
    out = C.run(spark, sf).collect()
    good = [tuple(r)[:5] for r in quality.good_documents(frame(spark, rows)).collect()]
    fps = [slow_fp(r[1]) for r in good]
    near = [(i, j) for i in range(len(good)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    best = {}
    for r, root in zip(good, components(len(good), near)):
        if r[0] is not None and (root not in best or r[0] < best[root][0]):
            best[root] = r
    kept = sorted(best.values())
    assert kept and all(r[0] is not None for r in kept)
    left = {r[0]: r[2] for r in slow(kept)}
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {}
    big = {}
    for i, t, *_ in kept:
        b, first = t.encode(), big
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first.get(b[k:k + 50], i) < i:
                gone[k:k + 50] = [True] * 50
        for k in range(len(b) - 49):
            big.setdefault(b[k:k + 50], i)
        assert sum(gone) == left[i]
        texts[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    sources = {r[0]: r[3] for r in kept}
    sizes, taken = {}, {}
    for i, t in texts.items():
        key = ("=" + sources[i] if sources[i] is not None else "~",)
        sizes[key] = sizes.get(key, 0) + len(t.encode().split())
    for r in out:
        assert r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        key = ("=" + r.source if r.source is not None else "~",)
        taken[key] = taken.get(key, 0) + len(texts[r.doc_id].encode().split())
    for (s,), target in {(s,): t for s, t in mixing.source_targets(sizes).items()}.items():
        assert abs(taken.get((s,), 0) - target) <= max(len(t.split()) for t in texts.values()) / 2 + 1


def test_empty(spark, tables):
    assert C.run(spark, tables([])).count() == 0


def test_components(spark):
    import random
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    roots = components(600, pairs)
    df = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long")
    got = {c.node: c.root for c in connected_components(df).collect()}
    linked = {i for p in pairs if p[0] != p[1] for i in p}
    assert got == {i: roots[i] for i in linked}
    assert connected_components(df.limit(0)).count() == 0
