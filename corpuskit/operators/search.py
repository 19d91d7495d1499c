"""Vector and keyword search for many queries at once (V-01 ... V-06).

Vector top-k is exact and visits as little of the corpus as it can. Rows lie in cells around centroids;
a cell's radius bounds every score in it (q x <= q c + |q| r, and <= |q| times the longest row). Each
query first visits the cells of the highest bounds until they hold ``k`` rows, and then those whose
bound its k-th score does not beat; the others can't hold a better row. Queries and rows meet in blocks
of a cell, scored by one matrix product, and each query's best ``k`` of a pair of blocks go on.

Keyword top-k looks at rare words first: see ``keyword_search``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  #: rows of a block of queries or of the corpus
CELLS, SAMPLE = 64, 4096  #: cells of a corpus, and rows that their centroids are fitted on

_HITS_SCHEMA = "query_id long, doc_id long, score double"


def _scaled(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1.0
    return m / n[:, None]


def _matrix(vecs) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vecs])


def _centroids(corpus: DataFrame, cells: int, sample: int, cosine: bool) -> np.ndarray | None:
    """k-means over the ``sample`` rows of the smallest id hashes; None without rows."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by ``sample``
    if not rows:
        return None
    x = _matrix([r["vec"] for r in rows])
    x = _scaled(x) if cosine else x
    c = np.unique(x[:cells], axis=0)
    for _ in range(8):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _cell_blocks(corpus: DataFrame, centroids: np.ndarray, cosine: bool, block: int) -> DataFrame:
    """(id, vec) -> blocks of at most ``block`` rows of one cell: cell, ids, vecs, radius, longest."""
    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = _matrix(pdf["vec"])
            x = _scaled(x) if cosine else x
            near = ((centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)
            far, norm, ids = np.linalg.norm(x - centroids[near], axis=1), np.linalg.norm(x, axis=1), pdf["id"].to_numpy()
            order = np.argsort(near, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
                for at in range(0, len(part), block):
                    p = part[at:at + block]
                    yield pd.DataFrame({"cell": [int(near[p[0]])], "ids": [ids[p].tolist()], "vecs": [list(x[p])],
                                        "radius": [float(far[p].max())], "longest": [float(norm[p].max())]})

    return corpus.mapInPandas(run, "cell int, ids array<long>, vecs array<array<double>>, radius double, longest double")


def _visits(queries: DataFrame, centroids: np.ndarray, about: dict, k: int, cosine: bool, block: int, second: bool) -> DataFrame:
    """(id, vec, floor) -> (cell, qids, qvecs): the cells of the highest bounds that hold ``k`` rows, or
    with ``second`` all others whose bound reaches ``floor``. ``about``: cell -> rows, radius, longest."""
    cells = np.array(sorted(about))
    rows, radius, longest = (np.array([about[c][i] for c in cells], dtype=np.float64) for i in range(3))

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            q, ids, floor = _matrix(pdf["vec"]), pdf["id"].to_numpy(), pdf["floor"].to_numpy(dtype=np.float64)
            q = _scaled(q) if cosine else q
            norm = np.linalg.norm(q, axis=1)[:, None]
            bound = np.minimum(q @ centroids[cells].T + norm * radius, norm * longest)
            bound = bound + 1e-9 * (1.0 + np.abs(bound))  # rounding must not hide a row
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(rows[order], axis=1) - rows[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            want = ~first & (bound >= np.where(np.isnan(floor), -np.inf, floor)[:, None]) if second else first
            for j, cell in enumerate(cells):
                hit = np.flatnonzero(want[:, j])
                for at in range(0, len(hit), block):
                    p = hit[at:at + block]
                    yield pd.DataFrame({"cell": [int(cell)], "qids": [ids[p].tolist()], "qvecs": [list(q[p])]})

    return queries.mapInPandas(run, "cell int, qids array<long>, qvecs array<array<double>>")


def _pair_topk(k: int, min_score: float | None):
    """The ``k`` best corpus rows per query of each pair of blocks, ties at the k-th score kept
    so that the order over all blocks stays exact."""
    def run(it):
        for pdf in it:
            for qids, qvecs, ids, vecs in zip(pdf["qids"], pdf["qvecs"], pdf["ids"], pdf["vecs"]):
                q, c = np.stack(list(qvecs)), np.stack(list(vecs))
                s = q @ c.T
                kk = min(k, s.shape[1])
                kth = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
                keep = s >= kth[:, None]
                if min_score is not None:
                    keep &= s >= min_score
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"query_id": np.asarray(qids, dtype=np.int64)[i], "doc_id": np.asarray(ids, dtype=np.int64)[j],
                                    "score": s[i, j]})
    return run


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding",
                qid_col: str = "query_id", qvec_col: str = "embedding", metric: str = "dot",
                threshold: float | None = None, threshold_mode: str = "after", block: int = BLOCK,
                cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """V-01 (``metric="dot"``, threshold after top-k) and V-02 (``metric="cosine"``, min score
    before top-k): ``query_id, doc_id, rank, score``; ties broken by doc id.

    F-08: ``threshold_mode="after"`` filters the k hits (profile after-topk);
    ``"before"`` drops low scores inside the kernel so k is filled from the rest (before-topk).
    Centroids are fitted on ``sample`` rows, all rows are searched; results do not depend on either."""
    from ..session import cut_lineage
    cosine = metric == "cosine"
    before = threshold if (threshold is not None and threshold_mode == "before") else None
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).dropna()
    q = queries.select(F.col(qid_col).cast("long").alias("id"), F.col(qvec_col).alias("vec")).dropna()
    centroids = _centroids(c, cells, sample, cosine)
    if centroids is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    blocks = cut_lineage(_cell_blocks(c, centroids, cosine, block))
    about = {r["cell"]: (r["n"], r["radius"], r["longest"]) for r in  # a row for each cell
             blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.max("radius").alias("radius"), F.max("longest").alias("longest")).collect()}

    def hits(visits: DataFrame) -> DataFrame:
        met = blocks.select("cell", "ids", "vecs").join(visits, "cell").select("qids", "qvecs", "ids", "vecs").repartition(n)
        return met.mapInPandas(_pair_topk(k, before), _HITS_SCHEMA)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    first = cut_lineage(ranked(hits(_visits(q.withColumn("floor", F.lit(None).cast("double")), centroids, about, k, cosine, block, False))))
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    waiting = q.join(kth, "id", "left")
    if before is not None:
        waiting = waiting.withColumn("floor", F.greatest("floor", F.lit(float(before))))
    top = ranked(first.drop("rank").unionByName(hits(_visits(waiting, centroids, about, k, cosine, block, True))))
    if threshold is not None and threshold_mode == "after":
        top = top.filter(F.col("score") >= threshold)
    return top.select("query_id", "doc_id", "rank", "score")


def context_text(hits: DataFrame, docs: DataFrame, text_col: str = "content", doc_key: str = "doc_id") -> DataFrame:
    """V-03: per query, "[i] (score: 0.000)\\ntext" blocks in rank order joined by a rule line."""
    j = hits.join(docs.select(F.col(doc_key).alias("doc_id"), F.col(text_col).alias("_t")), "doc_id")
    block = F.format_string("[%d] (score: %.3f)\n%s", F.col("rank"), F.col("score"), F.col("_t"))
    agg = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))  # <= k rows per query
    return j.groupBy("query_id").agg(F.array_join(F.transform(agg, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


# Answer texts of the extractive answerer.
ANSWER_PREFIX = "Based on the available information:\n\n"
NOT_FOUND = "I couldn't find relevant information to answer your question."


def extractive_answer(queries: DataFrame, hits: DataFrame, docs: DataFrame, text_col: str = "content",
                      doc_key: str = "doc_id", qid_col: str = "query_id") -> DataFrame:
    """V-04: the top hit's text prefixed, else the fixed not-found text; sources listed."""
    j = hits.join(docs.select(F.col(doc_key).alias("doc_id"), F.col(text_col).alias("_t")), "doc_id")
    best = j.groupBy("query_id").agg(F.min_by("_t", "rank").alias("_top"),
                                     F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))),
                                                 lambda x: x["doc_id"]).alias("sources"))
    q = queries.select(F.col(qid_col).alias("query_id")).join(best, "query_id", "left")
    return q.select("query_id", F.when(F.col("_top").isNull(), F.lit(NOT_FOUND))
                    .otherwise(F.concat(F.lit(ANSWER_PREFIX), F.col("_top"))).alias("answer"),
                    F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))


def upsert(index: DataFrame, updates: DataFrame, key: str = "id", seq: str = "load_seq") -> DataFrame:
    """V-05: same id replaces (the row with the highest load sequence wins); partial
    aggregation (``max_by``) instead of a per-id window."""
    u = index.unionByName(updates, allowMissingColumns=True)
    cols = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


WORD = r"(?U)\w+"
SALTS = 16
PROBE = 8  #: documents that the first words of a query name, for each hit wanted


def keyword_search(queries: DataFrame, docs: DataFrame, k: int = 5, qid_col: str = "query_id", q_col: str = "query",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V-06: score = share of distinct query words found in the document + 0.5 when the whole
    query occurs in it (case-insensitive); matched words; top k per query (score desc, doc id).

    Rare words come first. The rarest words of a query, as many as have ``PROBE`` documents a hit
    between them, name its first candidates, whose full counts give a k-th count m. A document that has
    none of the n - m + 1 rarest words has fewer than m, so those words alone are joined with their
    postings, on (word, salt); the other words, the common ones, are only looked up for the documents
    found that way. A document that holds a whole query holds all of its words, so the containment
    test reads only pairs with every word matched."""
    from ..session import cut_lineage

    def words(c):
        return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), 0))

    q = queries.select(F.col(qid_col).cast("long").alias("query_id"), F.lower(F.col(q_col)).alias("_q"), words(F.col(q_col)).alias("_w"))
    qw = q.select("query_id", F.size("_w").alias("_n"), F.explode("_w").alias("_word"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    post = cut_lineage(d.select("doc_id", F.explode(words(F.col("_t"))).alias("_word")).join(qw.select("_word").distinct(), "_word", "left_semi"))
    freq = post.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    rare = Window.partitionBy("query_id").orderBy("_df", "_word")  # a query's own words
    qw = cut_lineage(qw.join(freq, "_word").select(
        "query_id", "_n", "_word", F.row_number().over(rare).alias("_r"),
        F.coalesce(F.sum("_df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_seen")))
    salted = post.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))

    def having(own: DataFrame) -> DataFrame:
        return (salted.join(own.withColumn("_s", salts), ["_word", "_s"]).groupBy("query_id", "doc_id")
                .agg(F.count(F.lit(1)).alias("_m")))

    def looked_up(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """Postings of the documents in ``pairs`` for their query's words of ``own``."""
        return pairs.select("query_id", "doc_id").join(own.select("query_id", "_word"), "query_id").join(post, ["doc_id", "_word"])

    probe = having(qw.filter(F.col("_seen") < PROBE * k))
    best = looked_up(probe, qw).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_m"))
    count_rank = Window.partitionBy("query_id").orderBy(F.desc("_m"), "doc_id")
    kth = best.withColumn("_k", F.row_number().over(count_rank)).filter(F.col("_k") == k).select("query_id", F.col("_m").alias("_least"))
    # words that are in no document have no row here, but count in _n
    bounded = qw.join(kth, "query_id", "left").withColumn("_least", F.coalesce("_least", F.lit(0))).withColumn(
        "_here", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    bounded = cut_lineage(bounded.withColumn("_key", F.col("_r") <= F.col("_here") - F.col("_least") + 1))
    found = cut_lineage(having(bounded.filter("_key")))
    more = looked_up(found, bounded.filter("NOT _key")).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_more"))
    m = (found.join(more, ["query_id", "doc_id"], "left").join(q.select("query_id", F.size("_w").alias("_n")), "query_id")
         .select("query_id", "doc_id", "_n", (F.col("_m") + F.coalesce("_more", F.lit(0))).alias("_m")))
    full = (m.filter("_m = _n").select("query_id", "doc_id").join(q.select("query_id", "_q"), "query_id").join(d, "doc_id")
            .filter(F.contains(F.lower("_t"), F.col("_q"))).select("query_id", "doc_id", F.lit(0.5).alias("_bonus")))
    s = m.join(full, ["query_id", "doc_id"], "left").withColumn("score", F.col("_m") / F.col("_n") + F.coalesce("_bonus", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    terms = looked_up(top, qw).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("_word")).alias("matched_terms"))
    return top.join(terms, ["query_id", "doc_id"]).select("query_id", "doc_id", "rank", "score", "matched_terms")
