import random

import numpy as np
import pytest
import xxhash
from brute import CLASH, components, corpus, frame

from corpuskit.llm.simhash import keep_one, links, n_blocks, near_duplicates, simhash


def slow_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    from brute import WORDS
    w = WORDS.findall(low)
    if not w:
        return 0
    runs = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b C d e é" * 9, "x " * 5000])
def test_fingerprint(text):
    assert int.from_bytes(simhash(text), "big") == slow_fp(text)


def expected(rows):
    fps = [slow_fp(r[1]) for r in rows]
    roots = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, 1 << 60), r[0])
    return fps, roots, least


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates(spark, clash):
    rows = corpus()
    fps, roots, least = expected(rows)
    got = near_duplicates(frame(spark, rows, clash)).collect()
    mod = lambda f: f - (1 << 64) if f >> 63 else f
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], mod(f), least.get(root)) for r, f, root in zip(rows, fps, roots)), key=key)


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0


def test_keep_one(spark):
    rows = corpus()
    _, roots, least = expected(rows)
    df = frame(spark, rows, True)
    kept = keep_one(df).collect()
    assert kept and kept[0].asDict().keys() == set(df.columns) and all(k[c] == "x" for k in kept for c in CLASH)
    alone = [root for root in set(roots) if root not in least]
    assert len(kept) == len(set(roots))
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == sorted(least.values())
    assert sum(k.doc_id is None for k in kept) == len(alone)


@pytest.mark.parametrize(("blocks", "tile"), [(5, 4096), (6, 4096), (8, 16), (5, 8)])
def test_links_are_exact(spark, blocks, tile):
    """Any number of bit ranges, and buckets dealt as pairs of tiles, give the same components."""
    r = random.Random(blocks + tile)
    fps = {r.getrandbits(64) & ~0x1FFF for _ in range(150)}
    fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in list(fps)[:60] for _ in range(3)}
    x = np.array(sorted(fps), np.uint64)
    near = [(i, j) for i in range(len(x)) for j in np.nonzero(np.bitwise_count(x[i] ^ x[:i]) <= 4)[0].tolist()]
    want = components(len(x), near)
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    got = [(at[e.a], at[e.b]) for e in links(nodes, 4, blocks, tile).collect()]
    assert set(got) <= set(near) | {(b, a) for a, b in near} or components(len(x), got) == want
    assert components(len(x), got) == want


def test_blocks_grow_with_the_corpus():
    assert n_blocks(100) == 5 and n_blocks(10**7) > 5 and n_blocks(10**11) > n_blocks(10**7)
