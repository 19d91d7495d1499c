"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams, weighted by TF-IDF and scaled to length one. Every
language has several centroids (spherical k-means over a bounded sample of its labelled documents);
the text gets the language of the centroid with the largest cosine. A text farther from its centroid
than that centroid's own documents reach is told as rejected.

Document frequencies count all training documents: they are sums of vectors of fixed width, added up
in the tasks. Only the sample (``SAMPLE`` documents for each language) and the sums come to the
driver; prediction is one pass over the texts with no shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_value

DIM = 4096  #: width of a vector
GRAMS = (1, 2, 3)
CENTROIDS = 4  #: for each language
SAMPLE = 400  #: labelled documents of each language that the centroids are fitted on
ROUNDS = 10
REACH = 0.999  #: share of a centroid's sample within its reach
SLACK = 0.15  #: added to the reach
UNKNOWN = "und"
STEP = 1 << 20
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def gram_counts(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased letters, words set apart by one blank; None for
    NULL and for texts without a letter. Long texts are taken in steps that overlap by two."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    for i in np.nonzero(code > 0xFFFF)[0]:
        letter[i] = chr(code[i]).isalpha()
    if not letter.any():
        return None
    x = np.where(letter, code, 0).astype(np.uint64)
    x = x[(x != 0) | np.concatenate(([False], x[:-1] != 0))]  # one blank between words
    x = np.concatenate(([0], x[:-1] if x[-1] == 0 else x, [0])).astype(np.uint64)
    out = np.zeros(dim)
    for at in range(0, len(x), STEP):
        part = x[at:at + STEP + 2]
        for n in GRAMS:
            stop = min(len(part) - n + 1, STEP)
            if stop <= 0:
                continue
            h = np.full(stop, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k:k + stop]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out += np.bincount((h % np.uint64(dim)).astype(np.int64), minlength=dim)
    return out


def training(docs: DataFrame) -> Column:
    """Rows to learn from: a known language, and CRC-32 of the doc_id not in the held-out quarter."""
    return F.coalesce(F.col("lang").isNotNull() & ~_quarter(), F.lit(False))


def _quarter() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


class Model:
    """``idf`` (dim), ``centers`` (centroids x dim, length one), ``langs`` and ``reach`` of each."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str], reach: np.ndarray):
        self.idf, self.centers, self.langs, self.reach = idf, centers, langs, reach

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        size = np.linalg.norm(v)
        return v / size if size else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); ties go to the first language by name."""
        counts = gram_counts(text, len(self.idf))
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        cosine = np.round(self.centers @ self.vector(counts), 9)
        best = int(cosine.argmax())
        score = float(min(max(cosine[best], 0.0), 1.0))
        return self.langs[best], score, bool(1 - score > self.reach[best])


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and the centroid of each row. Starts from rows chosen farthest
    first, so equal input gives equal output."""
    chosen = [int((v @ v.mean(0)).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    centers = v[chosen].copy()
    for _ in range(rounds):
        own = (v @ centers.T).argmax(1)
        for c in range(len(centers)):
            if (own == c).any():
                m = v[own == c].sum(0)
                centers[c] = m / (np.linalg.norm(m) or 1)
    return centers, (v @ centers.T).argmax(1)


def fit(docs: DataFrame, dim: int = DIM, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Learn from ``docs`` (text, lang), rows without language or letters left out. Document
    frequencies are those of all rows; centroids see the ``sample`` rows of each language with the
    smallest hashes."""
    rows = docs.filter("lang is not null").select("text", "lang")

    def frequencies(batches):
        seen, n = np.zeros(dim, np.int64), 0
        for b in batches:
            for t in b.column("text"):
                if (c := gram_counts(t.as_py(), dim)) is not None:
                    seen += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(seen, n))], ["d", "n"])

    sums = rows.select("text").mapInArrow(frequencies, "d long, n long")
    df = np.zeros(dim + 1)
    for r in sums.groupBy("d").agg(F.sum("n").alias("n")).collect():  # a row for each dimension
        df[r["d"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    # the threshold hash of each language first, without texts; then the texts below it
    from pyspark.sql import Window
    hashed = rows.select("lang", F.xxhash64("text", "lang").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    most = hashed.withColumn("r", rank).filter(F.col("r") <= sample).groupBy("lang").agg(F.max("h").alias("most"))
    chosen = (rows.withColumn("h", F.xxhash64("text", "lang")).join(F.broadcast(most), "lang").filter("h <= most")
              .dropDuplicates(["lang", "h"]).select("lang", "h", "text"))

    def vectors(batches):
        for b in batches:
            got = [gram_counts(t.as_py(), dim) for t in b.column("text")]
            kept = [i for i, g in enumerate(got) if g is not None]
            at = [np.nonzero(got[i])[0].astype(np.int32) for i in kept]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").take(pa.array(kept, pa.int64())), b.column("h").take(pa.array(kept, pa.int64())),
                 pa.array(at, pa.list_(pa.int32())), pa.array([got[i][a].astype(np.int32) for i, a in zip(kept, at)], pa.list_(pa.int32()))],
                ["lang", "h", "at", "n"])

    by_lang = defaultdict(list)
    model = Model(idf, np.zeros((0, dim)), [], np.zeros(0))
    found = chosen.mapInArrow(vectors, "lang string, h long, at array<int>, n array<int>").collect()
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        counts = np.zeros(dim)
        counts[r["at"]] = r["n"]
        by_lang[r["lang"]].append(model.vector(counts))
    centers, langs, reach = [], [], []
    for lang, v in sorted(by_lang.items()):
        c, own = spherical_kmeans(np.array(v), centroids)
        for k in range(len(c)):
            far = 1 - (np.array(v)[own == k] @ c[k])
            centers.append(c[k])
            langs.append(lang)
            reach.append(float(np.quantile(far, REACH)) + SLACK if len(far) else SLACK)
    return Model(idf, np.array(centers).reshape(-1, dim), langs, np.array(reach))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score (cosine to the centroid), rejected. NULL texts and texts
    without letters are ``und`` with score 0, and so is every text if no language was learned;
    repeated rows stay; an empty table gives an empty result."""
    held = broadcast_value(docs.sparkSession, model)  # languages x centroids x DIM numbers

    def run(batches):
        m = held.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Fit on the training quarters and predict every row: doc_id, held_out, lang_pred, score,
    rejected. A NULL doc_id belongs to neither part: it is not learned from, and not held out."""
    train = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(train.filter(training(train) & F.col("doc_id").isNotNull()))
    return identified(docs, model).select("doc_id", F.coalesce(_quarter(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
