"""Brute-force versions and fixtures for the operators of corpuskit.llm."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what the operators use inside.
CLASH = ("id", "key", "sha", "fp", "size", "pattern", "copies", "anchor", "run", "row", "__row", "text_2")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=7):
    """Documents with copies, near copies, shared passages, NULLs, blanks, junk and a long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = say(70)
    texts = []
    for i in range(n):
        t = "\n".join((say(r.randint(5, 60)).capitalize() + ".") for _ in range(r.randint(1, 6)))
        if i % 9 == 3:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2:]
        if i % 7 == 5:
            t = texts[r.randrange(len(texts))] or ""
        if i % 11 == 6 and texts[-1]:
            w = texts[-1].split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        texts.append(t)
    texts[4], texts[8], texts[12], texts[16] = None, "", " \t\n ", "一二三 日本語 " * 30
    texts[20] = "!!! ### $$$ " * 60
    texts[24] = "long " + say(4000)
    texts[28] = "ab" * 400
    rows = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[2], "en", "a", 1), (None, None, None, None, None)]


def frame(spark, rows, clash=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df


def components(n, linked):
    """Smallest member of each component of 0 .. n-1; ``linked`` gives pairs."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
