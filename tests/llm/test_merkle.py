import hashlib
import zlib
from collections import defaultdict

import pytest
from brute import corpus, frame

from corpuskit.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tampered_text(row):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return low(row[1]) if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else None


def tree(digests, fan=16):
    """Root of a list, and for each entry the siblings of every level as (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p // fan * fan
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1:run + fan])))
        level = [H(*level[i:i + fan]) for i in range(0, len(level), fan)]
        at = [p // fan for p in at]
    return (level or [None])[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[(r[3] is not None, (r[3] or "").encode())].append(r)
    found, subs = [], []
    for s in sorted(by):
        group = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        sub, paths = tree([leaf_of(r, r[1]) for r in group])
        subs.append(sub)
        found.append((group, paths))
    root, tops = tree(subs)
    out = []
    for (group, paths), sub, top in zip(found, subs, tops):
        for r, p in zip(group, paths):
            path = p + top
            t = tampered_text(r)
            acc = leaf_of(r, r[1] if t is None else t)
            for a, b in path:
                acc = H(a, acc, b)
            out.append((r[0], leaf_of(r, r[1]), sub, root, H(*(x for s in path for x in s)), acc, acc == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in M.manifest(df).collect()), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_mixed_rows(spark, clash):
    rows = corpus()
    assert got(frame(spark, rows, clash)) == brute(rows)


def test_deep_and_shallow_sources(spark):
    """One source of several levels, lone rows, and more sources than one run holds."""
    rows = [(i, f"Text {i}", "en", "big", i) for i in range(700)]
    rows += [(1000 + i, "T" * (i + 1), None, f"s{i:02}é", 1) for i in range(300)]
    rows += [(2000 + i, "Pair", "de", f"p{i // 2}", 1) for i in range(40)] + [(None, None, None, None, None)] * 20
    want = brute(rows)
    assert got(frame(spark, rows).repartition(5)) == want
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("n, source", [(0, "a"), (1, "a"), (2, "a"), (16, None), (17, "a"), (257, "a")])
def test_one_source(spark, n, source):
    rows = [(i, f"Word {i}", "en", source, 1) for i in range(n)]
    assert got(frame(spark, rows)) == brute(rows)


def test_equal_rows_and_long_text(spark):
    rows = [(7, "Same", "en", "a", 4)] * 40 + [(7, "Other", "en", "a", 5)] * 3 + [(8, "Long " * 300_000, "en", "a", 1_500_000), (9, "", "", "", 0)]
    assert got(frame(spark, rows)) == brute(rows)
    paths = M.proofs(frame(spark, rows)).collect()
    assert len(paths) == len(rows) and all(p.presented is None for p in paths)
