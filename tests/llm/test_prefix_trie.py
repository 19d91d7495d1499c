import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import prefix_trie as T

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] += not children[seq]
        saved[seq] += (len(members[seq]) - 1) * (len(seq[-1][1].encode()) if seq else 0)
        if seq:
            leaves[seq[:-1]] += leaves[seq]
            saved[seq[:-1]] += saved[seq]
    return sorted(((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(children[seq]), leaves[seq], saved[seq],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == seq))).encode()).hexdigest())
                   for seq, m in members.items()), key=repr)


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, TURNS).repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in T.prefix_trie(df).collect()), key=repr)


def conversations(n=120, seed=3, missing=0.1):
    r = random.Random(seed)
    say = ["Hello", "Hi", "", None, "What is this?", "é" * 5, "a b", "ab"]
    rows = []
    for c in range(n):
        if r.random() < missing:
            continue
        start = r.choice([[], [("system", "One rule for all.")], [("system", "One rule for all."), ("user", "Hi")]])
        for t, (role, text) in enumerate(start + [(r.choice(["user", "assistant", None]), r.choice(say)) for _ in range(r.randint(1, 9))]):
            rows.append((c, t, role, text))
    return rows


def test_random_conversations(spark):
    rows = conversations()
    assert got(spark, rows) == brute(rows)


def test_copies_ties_nulls_and_clashing_names(spark):
    rows = conversations(30, 5) + [(c, t, "user", "copy") for c in range(200, 260) for t in range(3)]
    rows += [(3, 0, "user", "tied"), (3, 0, "assistant", "tied"), (3, 0, "assistant", "tied"), (3, None, "z", "first"), (None, 0, "user", "nobody"),
             (10**15 + 3, None, None, None), (400, 1, "user", "long " * 200_000), (401, 1, "user", "long " * 200_000)]
    want = brute(rows)
    assert got(spark, rows) == want
    extra = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("x").alias(c) for c in ("conv", "depth", "ref", "idx", "part", "total", "f", "up", "bytes")])
    assert sorted((tuple(r) for r in T.prefix_trie(extra).collect()), key=repr) == want


def test_long_conversation_and_many_ends(spark, monkeypatch):
    """A chain of several hundred nodes, and a node at which more conversations end than one block holds."""
    monkeypatch.setattr(T, "BLOCK", 7)
    rows = [(0, t, "user", f"t{t % 13}") for t in range(300)] + [(1, t, "user", f"t{t % 13}") for t in range(280)]
    rows += [(c, 0, "user", "same") for c in range(10, 80)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 0, "user", "x")], [(5, 0, "u", "a"), (6, 0, "u", "a")]])
def test_few_rows(spark, rows):
    assert got(spark, rows, 1) == brute(rows)


def test_fingerprints_that_meet_are_replaced(spark, monkeypatch):
    """Bases under which unequal prefixes share a fingerprint are found out, and others are taken."""
    rows, tried, real = conversations(40, 8), [], T.bases

    def weak(seed):
        tried.append(seed)
        return [1, 1, 1] if seed == 0 else real(seed)  # the order of turns makes no difference

    monkeypatch.setattr(T, "bases", weak)
    rows += [(300, 0, "u", "a"), (300, 1, "u", "b"), (305, 0, "u", "b"), (305, 1, "u", "a"), (300, 2, "u", "c"), (305, 2, "u", "c")]
    assert got(spark, rows) == brute(rows)
    assert 1 in tried


def test_composition():
    """Head and suffix products give the value of the joined sequence."""
    r = random.Random(1)
    for k, p in enumerate(T.MODULI):
        b = T.bases(0)[k]
        value = lambda seq: sum(v * pow(b, i + 1, p) for i, v in enumerate(seq)) % p
        for _ in range(50):
            head, own = [[r.randrange(1, p) for _ in range(r.randint(0, 9))] for _ in range(2)]
            h = r.randint(len(head), 9)
            moved = (value(own) - value(own[:h])) * pow(b, len(head) - h, p)
            assert (value(head) + moved) % p == value(head + own[h:])


def test_whole_table(spark, sf):
    from corpuskit.llm.queries import op12_prefix_trie
    from corpuskit.session import table
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in op12_prefix_trie(spark, sf).collect()), key=repr) == brute(rows)
