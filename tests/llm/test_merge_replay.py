import base64
import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from brute import corpus, frame

from corpuskit.llm import merge_replay as R

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


@pytest.fixture(scope="module")
def mine():
    with open(PATH, "rb") as f:
        return R.Replay(f.read(), PATTERN)


def test_any_text(library, mine):
    r = random.Random(1)
    bits = ["a", "the", "ing", "aaaa", "hahaha", "!!!!", "....", "12", "'s", "'LL", "'ll", "'", "İ", "ß", "é", "́", " ", "  ", "\n", "\n\n", "\t", "\r",
            "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "日本", "😀", "<|endoftext|>", "²", "Ⅷ", "_", "ﬁ", "\x00", "़", "١"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    for t, ids in zip(texts, mine.block(texts)):
        assert ids == library.encode_ordinary(t), repr(t)
        assert mine.decode(ids) == t.encode()


def test_every_character(library, mine):
    """Classes of characters are the library's."""
    texts = [f"a{chr(c)}{chr(c)} {chr(c)}1{chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 1 << 16):
        part = texts[at:at + (1 << 16)]
        for t, ids in zip(part, mine.block(part)):
            assert ids == library.encode_ordinary(t), repr(t)


def test_words_of_the_vocabulary(library, mine):
    r = random.Random(2)
    vocab = [t.decode("utf-8", "ignore") for t in mine.ranks]
    texts = ["".join(r.choice(vocab) for _ in range(4)) for _ in range(6000)]
    texts += ["".join(r.choice("abcdefgh") for _ in range(20000)), "a" * 5001, "ab" * 5001, "-=" * 3000, " " * 4001]
    for t, ids in zip(texts, mine.block(texts)):
        assert ids == library.encode_ordinary(t), repr(t[:100])


@pytest.mark.parametrize("seed", range(8))
def test_merges_out_of_order(seed):
    """Ranks in which a longer token comes before its parts, over all words of two letters."""
    r = random.Random(seed)
    more = list({"".join(r.choice("ab") for _ in range(r.randint(2, 5))) for _ in range(14)})
    r.shuffle(more)
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + k for k, t in enumerate(more)}
    spec = b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items())
    mine = R.Replay(spec, r"\S+|\s+")

    def merged(w):
        t = [bytes([b]) for b in w.encode()]
        if w.encode() in ranks:
            return [ranks[w.encode()]]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(t, t[1:])) if x + y in ranks), default=None)
            if best is None:
                return [ranks[x] for x in t]
            t[best[1]:best[1] + 2] = [t[best[1]] + t[best[1] + 1]]

    words = ["".join("ab"[k >> i & 1] for i in range(n)) for n in range(1, 11) for k in range(1 << n)]
    assert [list(x) for x in mine.block(words)] == [merged(w) for w in words]


def test_blocks_and_memory_change_nothing(library, mine, monkeypatch):
    monkeypatch.setattr(R, "REPLAY", 10)
    monkeypatch.setattr(R, "KNOWN", 5)
    texts = [" ".join(f"wörd{i * k % 11} Other{i}" for i in range(60)) for k in range(5)]
    for t in texts:
        assert mine.block([t]) == [library.encode_ordinary(t)]


@pytest.mark.parametrize("clash", [False, True])
def test_frames(spark, library, clash, monkeypatch):
    rows = corpus() + [(9999, "", None, None, 0), (10001, "word " * 400_000 + "x" * 300_000, "en", "a", 1)]
    df = frame(spark, rows, clash)
    want = {(r[0], r[1]): library.encode_ordinary(r[1] or "") for r in rows}
    got = R.encoded(df.withColumn("copy", df.text), PATH, PATTERN)
    assert [c for c in got.columns if c not in ("n_tokens", "token_ids")] == [c for c in [*df.columns, "copy"] if c != "text"]
    for r in R.decoded(got, PATH, PATTERN).collect():
        assert r.token_ids == want[r.doc_id, r.copy] and r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == (r.copy or "").encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(str(tuple(r)) for r in R.digests(df, PATH, PATTERN).collect()) == sorted(
        str((r[0], len(w := want[r[0], r[1]]), sha(" ".join(map(str, w)).encode()), sha((r[1] or "").encode()))) for r in rows)


def test_empty(spark):
    assert R.digests(frame(spark, []), PATH, PATTERN).count() == 0 and R.encoded(frame(spark, []), PATH, PATTERN).count() == 0


def test_whole_table(spark, sf, library):
    """The registered query against the library, over the smallest table."""
    from corpuskit.llm.queries import op11_merge_replay
    from corpuskit.session import table
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in op11_merge_replay(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
