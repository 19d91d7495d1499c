"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a flow routes
each pattern's word capacity to the quotas of its sources, where the r-th copy of a word costs more
than the one before (convex), so texts repeat only as far as the quotas ask. The flow network has a
node for each pattern and source: it is solved on the driver, and its size follows the number of
distinct source sets (a setting of the mix), never the number of documents.

A pattern's share is then filled with documents in seeded order. That needs no sort: word sums by
hash bin find the bin in which the share ends, and only that bin's rows are ordered. The outcome is
one threshold for each pattern, applied to the documents in place, without a shuffle of texts.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, written

SEED = 42
MAX_REPEAT = 2
DIGITS = 3  #: hexadecimal digits of a bin: 16^3 bins for each pattern


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


# ------------------------------------------------------------------ quotas

def water_filled(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``share`` of all sizes; none passes
    ``most`` times its size, the excess being reshared among the rest until none is above."""
    total = share * sum(sizes)
    caps = [most * s for s in sizes]
    if sum(sizes) == 0:
        return [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    capped, weight = 0.0, float(sum(weights))
    level = float("inf")
    for i in order:
        level = (total - capped) / weight
        if level * weights[i] <= caps[i]:
            break
        capped += caps[i]
        weight -= weights[i]
        level = float("inf")
    return [float(min(c, level * w)) for c, w in zip(caps, weights)]


# ------------------------------------------------------------------ flow

def min_cost_flow(capacity: dict[tuple, int], quota: dict, copies: int) -> dict[tuple, int]:
    """Flow in words from membership patterns (tuples of sources) to sources: at most ``quota``
    into each source, at most ``copies`` times ``capacity`` out of each pattern, as much as fits,
    at least total cost, where a pattern's r-th copy costs 2r - 1 a word.

    Successive shortest paths over residual arcs. Returns (pattern, source) -> words.
    """
    graph: dict = {}

    def arc(u, v, cap, cost):
        a, b = [v, cap, cost, None], [u, 0, -cost, None]
        a[3], b[3] = b, a
        graph.setdefault(u, []).append(a)
        graph.setdefault(v, []).append(b)
        return a

    routed = {}
    for p, words in sorted(capacity.items()):
        for r in range(copies):
            arc("from", ("p", p), words, 2 * r + 1)
        for s in p:
            routed[p, s] = arc(("p", p), ("s", s), words * copies, 0)
    for s, words in sorted(quota.items()):
        arc(("s", s), "to", words, 0)
    while "from" in graph and "to" in graph:
        dist, via, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for a in graph[u]:
                if a[1] > 0 and dist[u] + a[2] < dist.get(a[0], float("inf")):
                    dist[a[0]], via[a[0]] = dist[u] + a[2], a
                    if a[0] not in queued:
                        queue.append(a[0])
                        queued.add(a[0])
        if "to" not in dist:
            break
        path, at = [], "to"
        while at != "from":
            path.append(via[at])
            at = via[at][3][0]
        words = min(a[1] for a in path)
        for a in path:
            a[1] -= words
            a[3][1] += words
    return {k: a[3][1] for k, a in routed.items() if a[3][1]}


# ------------------------------------------------------------------ selection

def seeded(seed: int = SEED) -> Column:
    """Order in which a pattern's documents are taken; rows without doc_id go by their text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def thresholds(sized: DataFrame, share: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``sized`` (pattern, key, size) and ``share`` (pattern, rest: words to take of the next copy)
    -> (pattern, until): rows whose key is below ``until`` are taken. Rows of one key go together;
    the row in which the share ends is taken if more than half of it lies inside."""
    sized = sized.join(F.broadcast(share), "pattern").withColumn("bin", F.substring("key", 1, digits))
    bins = sized.groupBy("pattern", "bin", "rest").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = (bins.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
            .filter("before <= rest and rest < before + words").select("pattern", "bin", "before"))
    inside = (sized.join(F.broadcast(last), ["pattern", "bin"])  # one bin for each pattern
              .groupBy("pattern", "bin", "key", "rest", "before").agg(F.sum("size").alias("size")))
    w = Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0))
    out = inside.withColumn("out", 2 * start + F.col("size") >= 2 * F.col("rest"))
    # none left out in this bin: everything up to its end
    end = F.concat(F.max("bin"), F.lit("g"))
    return out.groupBy("pattern").agg(F.coalesce(F.min(F.when(F.col("out"), F.col("key"))), end).alias("until"))


def mix(docs: DataFrame, pattern: Column, quotas, copies: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: whole (its columns in one), doc_id, pattern, size (words) and copies (0 ..
    ``copies``).

    ``pattern``: sorted array of the sources (strings, never NULL) a row belongs to. ``quotas``:
    a function of {pattern: words} giving {source: words wanted}. NULL texts have no words; rows
    tied in key are taken together; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    named = docs.select(boxed(docs).alias("whole"), F.col("doc_id"), pattern.alias("pattern"), n_words().alias("size"), seeded(seed).alias("key"))
    sized = written(named.select("pattern", "key", "size"), "sized")
    capacity = {tuple(r["pattern"]): r["n"] for r in sized.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    flow = min_cost_flow(capacity, quotas(capacity), copies)
    taken = dict.fromkeys(capacity, 0)
    for (p, _), n in flow.items():
        taken[p] += n
    whole = {p: min(copies, taken[p] // n) if n else 0 for p, n in capacity.items()}
    rest = {p: taken[p] - whole[p] * n for p, n in capacity.items()}
    share = spark.createDataFrame([(list(p), r) for p, r in rest.items() if r], "pattern array<string>, rest long")
    found = {tuple(r["pattern"]): r["until"] for r in thresholds(sized, share).collect()}
    plan = spark.createDataFrame([(list(p), n, found.get(p, "")) for p, n in whole.items()],
                                 "pattern array<string>, full int, until string")
    # a row for each pattern, as many as the driver has just solved
    return (named.join(F.broadcast(plan), "pattern")
            .select("whole", "doc_id", "pattern", "size", (F.col("full") + (F.col("key") < F.col("until")).cast("int")).alias("copies")))


# ------------------------------------------------------------------ one source for each document

WEIGHTS = (5, 2, 1)
SHARE = 1.5


def source_key() -> Column:
    """The source as a pattern of one; a source ``s`` is named "=s", and a NULL one "~" (after
    every other in code-point order)."""
    return F.array(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")))


def source_targets(capacity: dict[tuple, int], weights: tuple = WEIGHTS, share: float = SHARE,
                   most: int = MAX_REPEAT) -> dict[str, float]:
    """Target of each source: weights repeat over the sources by code point, NULL last."""
    names = sorted(p[0] for p in capacity)
    shares = water_filled([capacity[(s,)] for s in names], [weights[i % len(weights)] for i in range(len(names))], share, most)
    return dict(zip(names, shares))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MAX_REPEAT,
                seed: int = SEED) -> DataFrame:
    """Per row of ``docs``, each belonging to its ``source``: whole, doc_id, size, copies, source_size
    and target (those of its source). NULL texts have no words, an empty table gives no rows."""
    targets: dict[str, float] = {}
    sizes: dict[str, int] = {}

    def quotas(capacity):
        targets.update(source_targets(capacity, weights, share, most))
        sizes.update({p[0]: n for p, n in capacity.items()})
        return {s: int(t + 0.5) for s, t in targets.items()}

    mixed = mix(docs, source_key(), quotas, most, seed)
    about = docs.sparkSession.createDataFrame([([s], sizes[s], t) for s, t in targets.items()],
                                              "pattern array<string>, source_size long, target double")
    return mixed.join(F.broadcast(about), "pattern").drop("pattern")  # a row for each source


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, '=' || source AS named, md5('{SEED}:' || doc_id) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
d AS (SELECT doc_id, coalesce(named, '~') AS s, k, size FROM sized),
src AS (SELECT s, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY s),
w AS (SELECT s, n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY s) - 1) % 3) + 1]::DOUBLE AS w FROM src),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, s) AS k FROM w),
steps AS (
  SELECT k, w, n,
         (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM o),
lv AS (SELECT min_by(level, k) AS level FROM steps WHERE level * w <= 2.0::DOUBLE * n),
t AS (SELECT s, n, least(2.0::DOUBLE * n, (SELECT level FROM lv) * w)::DOUBLE AS target FROM w),
f AS (SELECT s, n, target, CAST(floor(target + 0.5) AS BIGINT) AS q FROM t),
c AS (SELECT d.doc_id, d.size, f.n, f.target, f.q,
             coalesce(sum(d.size) OVER (PARTITION BY d.s ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN f USING (s))
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(CASE WHEN n = 0 THEN 0 ELSE size * (q // n + CASE WHEN 2 * before + size < 2 * (q % n) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM c
"""
