import hashlib
import random

import public_tokenizers
import pytest
from brute import corpus, frame
from tokenizers import Tokenizer as Library

from corpuskit.llm import bpe_automaton as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    with open(PATH, "rb") as f:
        return B.compiled(f.read())


def test_any_text(library, mine):
    r = random.Random(1)
    bits = ["a", "the", "ing", "aaaa", "hahaha", "!!!!", "....", "12", "'s", "'LL", "'", "İ", "Σ", "ς", "ß", "é", "é", "́", " ", "\n", "\t",
            "\x1c", "\x85", "\xa0", " ", "​", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|END", "²", "Ⅷ", "_", "ﬁ", "Å", "\x00", "　"]
    for _ in range(4000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert mine.encode(s) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(s)


def test_words_of_the_vocabulary(library, mine):
    r = random.Random(2)
    vocab = [t.replace("</w>", "") for t in mine.vocab]
    for _ in range(4000):
        s = "".join(r.choice(vocab) for _ in range(3))
        assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids, repr(s)
    long = "".join(r.choice("abcdefgh") for _ in range(20000))
    assert mine.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_automaton_accepts_only_merge_results():
    """All words over two letters up to nine, against merging pair by pair."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("ab", "ab"), ("b", "aa")]
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab", "abab", "baa"])}
    m = B.Automaton(vocab, merges)

    def merged(w):
        t = list(w)
        for u, v in merges:
            i = 0
            while i + 1 < len(t):
                if (t[i], t[i + 1]) == (u, v):
                    t[i:i + 2] = [u + v]
                i += 1
        return t

    def splits(w):
        if not w:
            yield []
        for t in vocab:
            if w.startswith(t):
                for rest in splits(w[len(t):]):
                    yield [t, *rest]

    for n in range(1, 10):
        for k in range(1 << n):
            w = "".join("ab"[k >> i & 1] for i in range(n))
            accepted = [s for s in splits(w) if all(m.arc(vocab[x], vocab[y]) for x, y in zip(s, s[1:]))]
            assert accepted == [merged(w)], w


def test_tables_turn_over(library, mine, monkeypatch):
    for name in ("TABLE", "RUNS", "WORDS"):
        monkeypatch.setattr(B, name, 3)
    with open(PATH, "rb") as f:
        t = B.Tokenizer(f.read())
    s = " ".join(f"word{i % 11} Other{i}" for i in range(60))
    assert t.encode(s) == library.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("clash", [False, True])
def test_frames(spark, library, clash):
    rows = corpus()
    df = frame(spark, rows, clash)
    want = sorted(str((r[0], e.ids)) for r, e in zip(rows, library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)))
    got = B.encoded(df, PATH)
    assert [c for c in got.columns if c not in ("n_tokens", "token_ids")] == [c for c in df.columns if c != "text"]
    assert sorted(str((r.doc_id, r.token_ids)) for r in got.collect()) == want and all(r.n_tokens == len(r.token_ids) for r in got.collect())
    for r in B.decoded(got, PATH).collect():
        assert r.decoded == library.decode(r.token_ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = sorted(map(str, [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(df, PATH).collect()]))
    assert digests == sorted(str((r[0], len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))))
                             for r, e in zip(rows, library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)))


def test_empty(spark):
    assert B.digests(frame(spark, []), PATH).count() == 0 and B.encoded(frame(spark, []), PATH).count() == 0
