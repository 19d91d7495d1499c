"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

1. ``fingerprints``: one pass over the texts; a bit is set when over half of the shingle hashes
   have it.
2. Equal fingerprints fold into one node before anything is compared (partial aggregation), so
   a group of copies of any size is one row.
3. ``links``: two fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of
   ``blocks`` bit ranges, so every near pair meets in at least one bucket keyed by such ranges.
   A bucket's fingerprints are ordered by population count and compared tile by tile with
   exclusive-or and bit counts; tiles whose counts differ by more than ``radius`` are skipped.
   A bucket above ``tile`` rows is dealt over tasks as pairs of tiles (population count, part),
   again only where the counts can be within the radius. Nothing is sampled or capped.
4. A bucket gives a spanning forest of its links, never all pairs; connected components join
   the forests.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, lean, written
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
SIDE = 1024


def simhash(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Fingerprint of one text as eight big-endian bytes. NULL, empty and blank texts give zero.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``shingle`` words
    joined by a space with repeats counted; fewer words make one shingle of the whole sequence.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED).to_bytes(8, "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())],
                      dtype=">u8").view(np.uint8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 19):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at:at + (1 << 19)]).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(starts)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``fp`` (the fingerprint as a signed long) for every row."""
    def run(batches):
        for b in batches:
            fps = b"".join(simhash(t.as_py(), shingle) for t in b.column("_text"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.frombuffer(fps, ">i8").astype("<i8"))],
                                             [*b.schema.names[:-1], "fp"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(lean(run), docs.select(*keep).schema.add("fp", "long"))


def _popcount(col):
    return F.bit_count(col)


def n_blocks(distinct: int, radius: int = RADIUS, tile: int = TILE) -> int:
    """Least number of bit ranges whose ``blocks - radius`` agreeing ranges key buckets of about
    ``tile / 8`` rows or fewer, were the bits even. Any number from ``radius + 1`` is exact."""
    blocks = radius + 1
    while blocks < 16 and distinct / 2 ** (64 * (blocks - radius) / blocks) > tile / 8:
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (smaller position, position) that span each component of the near pairs."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    x, c, n = fps[order], counts[order].astype(np.int64), len(fps)
    root = np.arange(n)
    tiles = [(a, min(a + SIDE, n)) for a in range(0, n, SIDE)]
    near = []
    for (a, b), (p, q) in itertools.combinations_with_replacement(tiles, 2):
        if c[p] - c[b - 1] > radius:
            continue
        i, j = np.nonzero(np.bitwise_count(x[a:b, None] ^ x[None, p:q]) <= radius)
        keep = i + a < j + p
        if keep.any():
            near.append((a + i[keep], p + j[keep]))
            if len(near) == 64:
                near = [_spanned(root, near)]
    if near:
        _spanned(root, near)
    child = np.nonzero(root != np.arange(n))[0]
    return list(zip(order[root[child]].tolist(), order[child].tolist()))


def _spanned(root: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray]:
    """Fold near pairs into ``root`` (smallest position of the component so far); returns the
    links of the folded forest, which stand for all pairs so far."""
    i = np.concatenate([a for a, _ in near])
    j = np.concatenate([b for _, b in near])
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root[:] = root[root]
        if np.array_equal(before, root):
            child = np.nonzero(root != np.arange(len(root)))[0]
            return root[child], child


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """``nodes`` (fp long, distinct) -> (a, b): links that span every component of the graph whose
    edges are the pairs of fingerprints with at most ``radius`` differing bits."""
    blocks = blocks or n_blocks(nodes.count(), radius, tile)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i])
            for i in range(blocks)]
    keys = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *[part[i] for i in chosen]).alias("v"))
            for k, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius))]
    met = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v")
    # buckets of one row have no pair; buckets above `tile` rows are dealt as pairs of tiles
    full = met.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = met.join(full, ["k", "v"])
    parts = F.when(F.col("n") > tile, F.ceil(F.col("n") / F.lit(tile))).otherwise(0).cast("int")
    mine = F.struct(_popcount(F.col("fp")).alias("c"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("p"))
    others = F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct((F.col("mine.c") + d).cast("int").alias("c"), p.cast("int").alias("p")))))
    none = F.struct(F.lit(-1).alias("c"), F.lit(0).alias("p"))
    pair = (met.withColumn("parts", parts)
            .withColumn("mine", F.when(F.col("parts") > 0, mine).otherwise(none))
            .withColumn("other", F.explode(F.when(F.col("parts") > 0, others).otherwise(F.array(none))))
            .select("fp", F.xxhash64("k", "v", F.least("mine", "other"), F.greatest("mine", "other")).alias("g")))

    def run(batches):
        held, group = [], None
        for b in batches:
            g, fp = b.column("g").to_numpy(), b.column("fp").to_numpy()
            cut = np.nonzero(np.diff(g))[0] + 1
            for at, piece in zip(np.concatenate(([0], cut)), np.split(fp, cut)):
                if len(piece) == 0:
                    continue
                if g[at] != group:
                    yield from done(held)
                    held, group = [], g[at]
                held.append(piece)
        yield from done(held)

    def done(held):
        if held and len(fps := np.unique(np.concatenate(held))) > 1:
            if found := _forest(fps.view(np.uint64), radius):
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], ["a", "b"])

    return pair.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per input row: doc_id, fp, component_id.

    ``component_id`` is the smallest doc_id among all rows reachable over links of at most
    ``radius`` differing bits; NULL when no reachable row has an id. NULL and blank texts have
    fingerprint zero and link like any other. Repeated rows stay, each with its result; an empty
    table gives an empty result; other columns are not read.
    """
    fps = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(nodes.select("fp"), radius))
    rooted = (nodes.join(parts, nodes.fp == parts.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (NULL last), then the smallest
    hash of the row; of rows equal in every column one stays. Columns are those of ``docs``."""
    whole = boxed(docs)
    keyed = docs.select(whole.alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("row"), F.col("text"))
    fps = written(fingerprints(keyed, shingle, ("doc_id", "row")), "fps")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))
    nodes = fps.groupBy("fp").agg(F.min(order).alias("first"))
    parts = connected_components(links(nodes.select("fp"), radius))
    first = (nodes.join(parts, nodes.fp == parts.node, "left")
             .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
             .select(F.col("first.doc_id").alias("id"), F.col("first.row").alias("key")))
    rows = fps.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = first.join(rows, first["id"].eqNullSafe(rows["doc_id"]) & (first["key"] == rows["row"])).select("id", "key", "n")
    kept = (keyed.join(first, keyed["doc_id"].eqNullSafe(first["id"]) & (keyed["row"] == first["key"]))
            .select("whole", "n", "id", "key"))
    return (kept.filter("n = 1").select("whole").union(kept.filter("n > 1").dropDuplicates(["id", "key"]).select("whole"))
            .select("whole.*"))
