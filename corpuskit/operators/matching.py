"""Question -> knowledge-base matching (J-13, J-14, A-24).

``sequence_match`` is the recipes' own: the sequence ratio of the texts, over all entries (J-14) or over
those that share a keyword, and all where none does (J-13). Questions and entries meet in blocks, dealt
by length, as a ratio is bounded by the lengths of both; inside a pair of blocks the characters of both
texts bound it again, and the ratio itself is computed for what can still reach the threshold and be
the best of its question.

``match`` is a profile of its own: candidates share a keyword (a word of more than
three characters), found by an equi-join on keywords alone with the question side salted, so that a
frequent word is dealt over several tasks. Shared words are counted on candidates, and so is the edit
similarity 1 - levenshtein / longer length, for all pairs of a batch at once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions.text import py_strip
from .search import SALTS, WORD

KEYWORD = 4  #: least characters of a keyword
QUESTIONS, ENTRIES = 32, 256  #: rows of a block
FIRST = 4  #: entries of a question that are scored whole before the others


def match(questions: DataFrame, kb: DataFrame, qid: str, q_col: str, kb_order: str, kb_q_col: str,
          mode: str = "ratio") -> DataFrame:
    """Best entry per question with a candidate: ``qid, kb_order, score``; ties keep the earlier
    entry. ``ratio``: edit similarity; ``keyword``: .7 edit similarity + .3 share of the question's
    words that the entry has."""
    def words(c):
        return F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), 0))

    q = questions.select(F.col(qid).cast("long").alias("qid"), F.lower(py_strip(q_col)).alias("_q"))
    k = kb.select(F.col(kb_order).cast("long").alias("kb_order"), F.lower(py_strip(kb_q_col)).alias("_t"))
    q, k = q.withColumn("_ws", words(F.col("_q"))), k.withColumn("_wt", words(F.col("_t")))
    keywords = lambda c: F.explode(F.filter(c, lambda w: F.length(w) >= KEYWORD))
    qw = q.select("qid", keywords(F.col("_ws")).alias("_w"), F.pmod(F.xxhash64("qid"), F.lit(SALTS)).alias("_s"))
    kw = k.select("kb_order", keywords(F.col("_wt")).alias("_w")).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    pairs = qw.join(kw, ["_w", "_s"]).select("qid", "kb_order").distinct()
    # few bytes, much work: as many tasks as the cluster runs, whatever the size of the rows
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = pairs.join(q, "qid").join(k, "kb_order").repartition(tasks)
    n, m = F.size("_ws"), F.size(F.array_intersect("_ws", "_wt"))
    like = 1 - _edits("_q", "_t") / F.greatest(F.length("_q"), F.length("_t"), F.lit(1))
    score = 0.7 * like + 0.3 * m / n if mode == "keyword" else like
    best = F.max_by(F.struct("kb_order", "score"), F.struct("score", -F.col("kb_order")))
    return c.withColumn("score", score).groupBy("qid").agg(best.alias("b")).select("qid", "b.kb_order", "b.score")


def _edits(first: str, second: str):
    """Levenshtein distance of two columns."""
    @F.pandas_udf("long")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        (i, firsts), (j, seconds) = pd.factorize(a.fillna("")), pd.factorize(b.fillna(""))
        return pd.Series(Q.edit_distances(list(firsts), list(seconds), i, j))

    return found(F.col(first), F.col(second))


# ------------------------------------------------------------------ sequence ratio

#: How each recipe prepares texts, its threshold, whether a score at the threshold is enough.
PROFILES = {"simple": (lambda t: t.lower().strip(), 0.4, True), "train": (str.lower, 0.5, False), "keyword": (str.lower, 0.4, False)}
_WORDS = re.compile(r"\b\w+\b").findall


def _length_class(n: int) -> int:
    return int(math.log2(n + 1))


def _reach(cls: int, ratio: float, classes: int) -> list[int]:
    """Length classes whose texts can have ``ratio`` with a text of class ``cls``."""
    ends = lambda c: (2 ** c - 1, 2 ** (c + 1) - 1)
    low, high = ends(cls)
    out = []
    for c in range(classes):
        lo, hi = ends(c)
        small, large = (high, lo) if high < lo else (hi, low) if hi < low else (1, 1)
        if 2 * small >= ratio * (small + large) - 1e-9:
            out.append(c)
    return out


#: Length classes (texts of up to 2^31 characters).
CLASSES = 32


def _blocked(df: DataFrame, prepared, size: int, needed: float, spread: bool) -> DataFrame:
    """(id, text, some: whether any entry shares a keyword) -> blocks of one length class: cls, ids,
    texts, some. With ``spread``, a block goes to every class that can reach the ``needed`` ratio;
    where nothing is needed, all texts are one class."""
    def run(frames):
        for pdf in frames:
            rows = ((prepared(x or ""), i, bool(s)) for i, x, s in zip(pdf["id"], pdf["text"], pdf["some"]))
            rows = sorted((_length_class(len(t)) if needed > 0 else 0, len(t), i, t, s) for t, i, s in rows)
            for cls, group in groupby(rows, key=lambda r: r[0]):
                group = list(group)
                for at in range(0, len(group), size):
                    _, _, ids, texts, some = map(list, zip(*group[at:at + size]))
                    reach = _reach(cls, needed, CLASSES) if spread and needed > 0 else [cls]
                    yield pd.DataFrame({"cls": reach, "ids": [ids] * len(reach), "texts": [texts] * len(reach), "some": [some] * len(reach)})

    return df.mapInPandas(run, "cls int, ids array<long>, texts array<string>, some array<boolean>")


def _overlaps(questions: list[str], entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each question's words that an entry has, and whether they share a keyword."""
    having = defaultdict(list)
    for j, t in enumerate(entries):
        for w in set(_WORDS(t)):
            having[w].append(j)
    share, key = np.zeros((len(questions), len(entries))), np.zeros((len(questions), len(entries)), bool)
    for i, t in enumerate(questions):
        words = set(_WORDS(t))
        for w in words:
            if found := having.get(w):
                share[i, found] += 1
                if len(w) >= KEYWORD:
                    key[i, found] = True
        share[i] /= max(len(words), 1)
    return share, key


def _scores(m: Q.Matching, scale: float, extra, least: float) -> np.ndarray:
    """``scale`` * ratio + ``extra`` of pairs, -1 where it is below ``least`` or can't be the best of the
    question: pairs with a long first block are finished first, the others as far as they can beat these."""
    total = m.a.size[m.i] + m.b.size[m.j]
    half = np.maximum(total, 1) / 2

    def score(chars):
        return np.where(total > 0, chars / half, 1.0) * scale + extra

    def finish(pairs, low):
        m.finish(pairs, np.where(total > 0, (low - extra) / scale * half, 0.0) - 1e-6)

    guess = score(m.found)
    order = np.lexsort((-guess, m.i))
    rank = np.arange(len(order)) - np.searchsorted(m.i[order], m.i[order])
    finish(order[rank < FIRST], least)
    got = np.full(len(order), -1.0)
    best = np.zeros(int(m.i.max()) + 1)
    done = order[rank < FIRST]
    got[done] = np.where(m.most[done] == m.found[done], score(m.found)[done], -1.0)
    np.maximum.at(best, m.i[done], got[done])
    finish(order[rank >= FIRST], np.maximum(best[m.i], least))
    return np.where(m.most == m.found, score(m.found), -1.0)


def _best_of_blocks(keyword: bool, least: float):
    """For each question of a pair of blocks its best entry above ``least`` (0: above nothing)."""
    def run(frames):
        for pdf in frames:
            for qids, qs, some, ids, ts in zip(pdf["qids"], pdf["qtexts"], pdf["some"], pdf["ids"], pdf["texts"]):
                qs, ts, ids = list(qs), list(ts), np.asarray(ids, np.int64)
                letters = Q.alphabet(qs, ts)
                a, b = Q.Texts(qs, letters), Q.Texts(ts, letters)
                bound, open_, extra, scale = Q.upper_bounds(a, b), np.ones((len(qs), len(ts)), bool), 0.0, 1.0
                if keyword:
                    share, key = _overlaps(qs, ts)
                    open_, extra, scale = key | ~np.asarray(some, bool)[:, None], 0.3 * share, 0.7
                bound = np.where(open_, scale * bound + extra, -1.0)
                score = np.full(bound.shape, -1.0)
                i, j = np.nonzero((bound >= least - 1e-9) & (bound > 0))
                if len(i):
                    more = extra[i, j] if keyword else 0.0
                    score[i, j] = _scores(Q.Matching(a, b, i, j), scale, more, least)
                high = score.max(axis=1)
                order = np.where(score == high[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
                keep = high > 0
                yield pd.DataFrame({"qid": np.asarray(qids, np.int64)[keep], "kb_order": order[keep], "score": high[keep]})
    return run


def sequence_match(questions: DataFrame, kb: DataFrame, qid: str, q_col: str, kb_order: str, kb_q_col: str,
                   profile: str = "simple", below: bool = True) -> DataFrame:
    """Best entry per question by the sequence ratio of its ``profile``: qid, kb_order, score; ties
    keep the earlier entry, and a score of 0 is no match. ``keyword`` (J-13): .7 ratio + .3 share of
    the question's words, among entries that share a keyword, or all if none does. With ``below``
    also the best of a question that stays under the threshold, else entries that can't reach it are
    passed over by their length. NULL texts are empty; an empty side gives no rows."""
    prepared, least, _ = PROFILES[profile]
    keyword = profile == "keyword"
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = questions.select(F.col(qid).cast("long").alias("id"), F.col(q_col).alias("text")).filter("id IS NOT NULL")
    k = kb.select(F.col(kb_order).cast("long").alias("id"), F.col(kb_q_col).alias("text")).filter("id IS NOT NULL")
    if keyword:
        known = k.select(_keywords("text").alias("_w")).distinct()
        some = q.select("id", _keywords("text").alias("_w")).join(known, "_w", "left_semi").select("id").distinct().withColumn("some", F.lit(True))
        q = q.join(some, "id", "left").withColumn("some", F.coalesce("some", F.lit(False)))
    else:
        q = q.withColumn("some", F.lit(False))
    floor = 0.0 if below else (least - 0.3) / 0.7 if keyword else least
    qb = _blocked(q, prepared, QUESTIONS, floor, True).select("cls", F.col("ids").alias("qids"), F.col("texts").alias("qtexts"), "some")
    kb_ = _blocked(k.withColumn("some", F.lit(False)), prepared, ENTRIES, floor, False).select("cls", "ids", "texts")
    pairs = qb.join(kb_, "cls").select("qids", "qtexts", "some", "ids", "texts").repartition(4 * n)
    hits = pairs.mapInPandas(_best_of_blocks(keyword, 0.0 if below else least), "qid long, kb_order long, score double")
    best = F.max_by(F.struct("kb_order", "score"), F.struct("score", -F.col("kb_order")))
    return hits.groupBy("qid").agg(best.alias("b")).select("qid", "b.kb_order", "b.score")


def _keywords(column: str):
    """Words of ``KEYWORD`` or more characters, a row each, as the recipe finds them."""
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({w for w in _WORDS((t or "").lower()) if len(w) >= KEYWORD}))

    return F.explode(found(F.col(column)))


def best_answers(questions: DataFrame, kb: DataFrame, qid: str, q_col: str, kb_order: str, kb_q_col: str,
                 kb_a_col: str, profile: str = "simple", similarity: str = "edit") -> DataFrame:
    """J-14 (profiles ``simple``, ``train``) and J-13 (``keyword``). Unmatched questions get the
    profile's fixed not-found answer.

    ``similarity="sequence"``: scores of ``sequence_match``, found at the recipe's threshold (``simple``
    >= .4, ``train`` > .5, ``keyword`` > .4). ``"edit"``: scores of ``match``, at the same thresholds
    or above."""
    if similarity == "sequence":
        _, least, equal = PROFILES[profile]
        m = sequence_match(questions, kb, qid, q_col, kb_order, kb_q_col, profile, below=False)
        ok = F.coalesce((F.col("score") >= least) if equal else (F.col("score") > least), F.lit(False))
    else:
        m = match(questions, kb, qid, q_col, kb_order, kb_q_col, "keyword" if profile == "keyword" else "ratio")
        ok = F.coalesce(F.col("score") >= (0.5 if profile == "train" else 0.4), F.lit(False))
    # Not-found answers of the three profiles.
    none = {"simple": "I don't have an answer for that yet.", "train": "I'm not sure how to answer that. Can you rephrase?",
            "keyword": "I couldn't find an answer. Try rephrasing or contact support."}[profile]
    answers = kb.select(F.col(kb_order).cast("long").alias("kb_order"), F.col(kb_a_col).alias("_a"))
    r = questions.select(F.col(qid).cast("long").alias("qid")).join(m, "qid", "left").join(answers, "kb_order", "left")
    return r.select("qid", F.when(ok, F.col("_a")).otherwise(F.lit(none)).alias("answer"),
                    F.when(ok, F.col("score")).otherwise(F.lit(0.0)).alias("confidence"),
                    F.when(ok, F.col("kb_order")).alias("matched"), ok.alias("found"))
