import re

import numpy as np

from corpuskit.operators import search as V


def test_vector_topk_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 8))
    queries = rng.normal(size=(7, 8))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<double>").repartition(4)
    qdf = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    for metric in ("dot", "cosine"):
        got = {(r.query_id, r.rank): r.doc_id for r in V.vector_topk(cdf, qdf, 4, metric=metric).collect()}
        c = corpus / np.linalg.norm(corpus, axis=1)[:, None] if metric == "cosine" else corpus
        for qi, q in enumerate(queries):
            qq = q / np.linalg.norm(q) if metric == "cosine" else q
            order = sorted(range(len(c)), key=lambda j: (-(c[j] @ qq), j))[:4]
            assert [got[(100 + qi, r)] for r in range(1, 5)] == order


def test_vector_topk_blocks_equal_single(spark):
    rng = np.random.default_rng(5)
    cdf = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "query_id long, embedding array<double>")
    a = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in V.vector_topk(cdf, qdf, 3).collect())
    b = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in V.vector_topk(cdf, qdf, 3, block=2).collect())
    assert a == b


def test_threshold_before_vs_after(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.1, 0.0])], "id long, embedding array<double>")
    qdf = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    after = [r.doc_id for r in V.vector_topk(cdf, qdf, 2, threshold=0.2).orderBy("rank").collect()]
    before = [r.doc_id for r in V.vector_topk(cdf, qdf, 2, threshold=0.6, threshold_mode="before").orderBy("rank").collect()]
    assert after == [1, 2] and before == [1]


def test_keyword_search_bruteforce(spark):
    docs = [(1, "The quick brown fox"), (2, "quick quick dog"), (3, "a lazy fox jumps"), (4, "nothing here")]
    qs = [(10, "quick fox"), (11, "lazy fox jumps")]
    got = {(r.query_id, r.doc_id): r.score for r in V.keyword_search(
        spark.createDataFrame(qs, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    for qid, q in qs:
        qt = set(re.findall(r"\b\w+\b", q.lower()))
        for did, t in docs:
            m = qt & set(re.findall(r"\b\w+\b", t.lower()))
            if m:
                s = len(m) / len(qt) + (0.5 if q.lower() in t.lower() else 0)
                assert abs(got[(qid, did)] - s) < 1e-12
            else:
                assert (qid, did) not in got


def test_upsert_and_context(spark):
    idx = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, content string, load_seq int")
    upd = spark.createDataFrame([(1, "a2", 1)], "id long, content string, load_seq int")
    assert sorted(tuple(r) for r in V.upsert(idx, upd).collect()) == [(1, "a2", 1), (2, "b", 0)]
    hits = spark.createDataFrame([(7, 1, 1, 0.91234), (7, 2, 2, 0.5)], "query_id long, doc_id long, rank int, score double")
    docs = spark.createDataFrame([(1, "first"), (2, "second")], "doc_id long, content string")
    ctx = V.context_text(hits, docs).first().context
    assert ctx == "[1] (score: 0.912)\nfirst\n\n---\n\n[2] (score: 0.500)\nsecond"
    q = spark.createDataFrame([(7,), (8,)], "query_id long")
    ans = {r.query_id: r.answer for r in V.extractive_answer(q, hits, docs).collect()}
    assert ans[7].endswith("first") and ans[8] == V.NOT_FOUND


def test_keyword_search_ties_and_blocks(spark):
    docs = [(i, "common word " + ("rare" if i % 10 == 0 else "other")) for i in range(60)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    qdf = spark.createDataFrame([(1, "common"), (2, "rare word"), (3, "zzz")], "query_id long, query string")
    got = {}
    for r in V.keyword_search(qdf, ddf, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    assert sorted(got[1]) == [(1, 0), (2, 1), (3, 2)]  # all tie at 1.0 + 0.5: lowest doc ids win
    assert [d for _, d in sorted(got[2])] == [0, 10, 20] and 3 not in got


def test_vector_cells_give_the_exact_top(spark):
    """Clustered rows, far rows, equal rows and zero rows; few cells, many cells, a small sample."""
    rng = np.random.default_rng(9)
    corpus = np.concatenate([rng.normal(size=(12, 6))[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 6)),
                             20 * rng.normal(size=(5, 6)), np.zeros((3, 6)), np.ones((40, 6))])
    queries = np.concatenate([rng.normal(size=(20, 6)), np.zeros((1, 6)), np.ones((1, 6))])
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<double>").repartition(5)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>").repartition(2)
    for metric, k, cells, sample, least in (("dot", 4, 64, 4096, None), ("cosine", 7, 16, 64, 0.2), ("dot", 60, 3, 10, None), ("dot", 1000, 8, 50, 0.0)):
        got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in V.vector_topk(
            cdf, qdf, k, metric=metric, threshold=least, threshold_mode="before", cells=cells, sample=sample, block=32).collect()}
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1)[:, None]
        score = unit(queries) @ unit(corpus).T if metric == "cosine" else queries @ corpus.T
        for i in range(len(queries)):
            kept = [j for j in range(len(corpus)) if least is None or score[i, j] >= least]
            want = sorted((-round(score[i, j], 9) for j in kept))[:k]
            mine = [got[i, r] for r in range(1, len(want) + 1)]
            assert (i, len(want) + 1) not in got and len({d for d, _ in mine}) == len(want)
            assert np.allclose([s for _, s in mine], [-x for x in want]) and all(abs(score[i, d] - s) < 1e-9 for d, s in mine)


def test_vector_cells_pass_over_most_of_a_clustered_corpus(spark):
    rng = np.random.default_rng(4)
    centres = 10 * rng.normal(size=(16, 8))
    corpus = spark.createDataFrame([(i, (centres[i % 16] + 0.1 * rng.normal(size=8)).tolist()) for i in range(800)], "id long, vec array<double>")
    c = V._centroids(corpus, 64, 400, True)
    blocks = V._cell_blocks(corpus, c, True, 64)
    about = {r["cell"]: (r["n"], r["radius"], r["longest"]) for r in blocks.groupBy("cell").agg(
        V.F.sum(V.F.size("ids")).alias("n"), V.F.max("radius").alias("radius"), V.F.max("longest").alias("longest")).collect()}
    q = spark.createDataFrame([(0, centres[3].tolist(), 0.99)], "id long, vec array<double>, floor double")
    met = V._visits(q, c, about, 5, True, 64, False).unionByName(V._visits(q, c, about, 5, True, 64, True)).select("cell").distinct().collect()
    assert sum(about[r.cell][0] for r in met) < 200


def test_vector_search_without_rows(spark):
    e = spark.createDataFrame([], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert V.vector_topk(e, q).count() == 0 and V.vector_topk(q.withColumnRenamed("query_id", "id"), e.withColumnRenamed("id", "query_id")).count() == 0


def test_keyword_search_equals_every_pair(spark, monkeypatch):
    import random
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(vocab[min(59, int(r.expovariate(0.12)))] for _ in range(n))
    docs = [say(r.randint(0, 40)) for _ in range(150)] + [None, "", "Alpha Beta"] + [say(6)] * 20
    qs = [say(r.randint(1, 14)) for _ in range(40)] + ["", "nowhere", "nowhere w1 w0", "alpha beta", docs[3], docs[160]]
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    qdf = spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    for k, probe in ((1, 1), (5, 8), (30, 2)):
        monkeypatch.setattr(V, "PROBE", probe)
        got = {(x.query_id, x.rank): (x.doc_id, round(x.score, 9), x.matched_terms) for x in V.keyword_search(qdf, ddf, k).collect()}
        n = 0
        for i, q in enumerate(qs):
            words = set(re.findall(r"\w+", (q or "").lower()))
            rows = []
            for j, t in enumerate(docs):
                both = words & set(re.findall(r"\w+", (t or "").lower()))
                if both:
                    rows.append((-(len(both) / len(words) + (0.5 if q.lower() in t.lower() else 0)), j, sorted(both)))
            for rank, (s, j, terms) in enumerate(sorted(rows)[:k], 1):
                assert got[i, rank] == (j, round(-s, 9), terms), (q, k)
                n += 1
        assert n == len(got)
