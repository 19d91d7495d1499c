"""Merkle manifest of a dataset: a proof for every document, by pointer jumping.

Leaves of a source ascend by doc_id; every ``FAN`` consecutive nodes become one, level by level, up
to the source's subroot, and subroots ordered by source go on to the root. Trees are built a level at
a time, each an aggregation over runs of ``FAN`` nodes.

Proofs come from pointer jumping: a node holds a pointer to an ancestor and the segment of siblings on
the way there. One self-join replaces the pointer by the ancestor's own and joins the two segments, so
the distance doubles and some log2(height) joins bring every node to the root. The leaves of a run
share everything above their parent, so they travel as one row and are told apart at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .numbering import numbered

#: Nodes that become one.
FAN = 16
#: Tree of the subroots; trees of sources are named "0" (NULL) or "1" and the source.
TOP = "2"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` for NULL, else its UTF-8 byte count, ``:`` and itself."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a row of ``documents`` with ``text`` as its text."""
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def every_fifth(text: Column) -> Column:
    """Tampering of the query: where 5 divides the CRC-32 of doc_id, A-Z become a-z."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate(text, CAPITALS, SMALL))


# ------------------------------------------------------------------ trees

def _run_id(level: int) -> Column:
    return F.struct("tree", F.lit(level).alias("level"), "idx")


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """nodes (tree, idx, total, id, digest, leaf) of ``level`` - 1 -> runs (id, tree, idx, total,
    digest, children) of ``level``. Trees of one node are done."""
    child = F.struct(F.col("idx").alias("at"), "id", "digest", "leaf")
    runs = (nodes.filter("total > 1").withColumn("run", F.floor(F.col("idx") / FAN))
            .groupBy("tree", "run").agg(F.array_sort(F.collect_list(child)).alias("children"), F.max("total").alias("below")))
    return runs.select("tree", F.col("run").alias("idx"), F.ceil(F.col("below") / FAN).alias("total"), "children").select(
        _run_id(level).alias("id"), "tree", "idx", "total", "children",
        F.sha2(F.array_join(F.col("children.digest"), ""), 256).alias("digest"))


def _height(total: int) -> int:
    height = 0
    while total > 1:
        total, height = -(-total // FAN), height + 1
    return height


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Runs of every level above ``nodes``, each written once."""
    out = []
    for level in range(1, height + 1):
        out.append(written(_runs(nodes, level), f"runs{level}", collect=False))
        nodes = out[-1].withColumn("leaf", F.lit(None).cast(nodes.schema["leaf"].dataType))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _steps(children: Column) -> Column:
    """Each child with the digests to its left and right."""
    all_of = lambda part: F.array_join(F.transform(part, lambda c: c["digest"]), "")
    return F.transform(children, lambda c, i: F.struct(
        c["id"].alias("id"), c["digest"].alias("digest"), c["leaf"].alias("leaf"),
        F.struct(all_of(F.slice(children, F.lit(1), i)).alias("left"),
                 all_of(F.slice(children, i + 2, F.lit(FAN))).alias("right")).alias("step")))


def _jumped(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (id, up, path, subroot) -> the same with every ``up`` at the root and ``path`` on the
    whole way. A node passes its subroot where it does not have it yet."""
    distance = 1
    while distance < height:
        nodes = written(nodes, "jumped", collect=False)
        far = nodes.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("subroot").alias("__subroot"))
        going, there = nodes.filter("up IS NOT NULL"), nodes.filter("up IS NULL")
        nodes = there.unionByName(going.join(far, F.col("up") == F.col("__id")).select(
            "id", F.col("__up").alias("up"), F.concat("path", "__path").alias("path"), F.coalesce("subroot", "__subroot").alias("subroot")))
        distance *= 2
    return nodes


def proofs(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, presented
    (the leaf with ``presented`` as its text where that is not NULL, else NULL), subroot, root and path:
    from the leaf to the root, the siblings to the left and to the right, as concatenated digests.

    NULL sources are a source of their own, the first; NULL doc_ids come first in their source, and rows
    that share a doc_id follow their leaf digest. Equal rows are leaves of their own. A source of one
    row has its leaf as subroot; a table of one row has it as root, with an empty path; an empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    presented = F.lit(None).cast("string") if presented is None else presented
    leaves = written(docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("tree"), F.col("doc_id").alias("doc_id"),
        leaf_digest(F.col("text")).alias("digest"), F.when(presented.isNotNull(), leaf_digest(presented)).alias("presented")),
        "leaves", collect=False)
    placed = numbered(leaves, ["tree"], ["doc_id", "digest"])
    placed = written(placed.select("tree", "idx", "total", _run_id(0).alias("id"), "digest",
                                   F.struct("doc_id", "presented").alias("leaf")), "placed", collect=False)
    largest = placed.agg(F.max("total")).first()[0] or 0
    below = _levels(placed, _height(largest))

    columns = ["tree", "id", "digest", "leaf"]
    no_leaf = F.lit(None).cast(placed.schema["leaf"].dataType)
    subroots = written(_union([x.filter("total = 1").withColumn("leaf", no_leaf if k else F.col("leaf")).select(*columns)
                               for k, x in enumerate([placed, *below])]), "subroots", collect=False)
    tops = numbered(subroots, [], ["tree"]).withColumn("tree", F.lit(TOP))
    n_sources = subroots.count()
    above = _levels(tops, _height(n_sources))
    # the root: one digest and one id, whatever the table's size
    root = (above[-1] if above else subroots).select("id", "digest").first()
    if root is None:
        root = {"id": None, "digest": None}

    # nodes above the leaves, and subroots that are leaves
    at_root = spark.range(1).select(F.lit(True).alias("x")).filter(F.lit(root["id"] is not None)).select(
        (F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("tree", "level", "idx"), root["id"] or (None,) * 3, ("string", "int", "long"))])).alias("id"),
        F.lit(None).cast("struct<tree:string,level:int,idx:bigint>").alias("up"),
        F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"), F.lit(root["digest"]).alias("subroot"))
    exploded = [x.select(F.col("id").alias("up"), F.explode(_steps(F.col("children"))).alias("c")).select(
        F.col("c.id").alias("id"), "up", F.array("c.step").alias("path"),
        (F.col("c.digest") if top else F.lit(None).cast("string")).alias("subroot"))
        for x, top in [*[(x, False) for x in below[1:]], *[(x, k == 0) for k, x in enumerate(above)]]]
    nodes = _jumped(_union([at_root, *exploded]), len(below) + len(above))

    # the run of a leaf goes to its parent, a leaf that is a subroot to itself
    bare = F.array(F.struct("id", "digest", "leaf", F.lit(None).cast("struct<left:string,right:string>").alias("step")))
    units = [placed.filter("total = 1").select("id", bare.alias("members"))]
    if below:
        units.append(below[0].select("id", _steps(F.col("children")).alias("members")))
    return (_union(units).join(nodes.drop("up"), "id").select(F.explode("members").alias("m"), "path", "subroot")
            .select(F.col("m.leaf.doc_id").alias("doc_id"), F.col("m.digest").alias("leaf"), F.col("m.leaf.presented").alias("presented"),
                    "subroot", F.lit(root["digest"]).cast("string").alias("root"),
                    F.when(F.col("m.step").isNull(), F.col("path")).otherwise(F.concat(F.array("m.step"), F.col("path"))).alias("path")))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def manifest(docs: DataFrame, tampered=every_fifth) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256 (of all siblings on its path),
    folded_root (from the tampered leaf where ``tampered`` gives a text, else from the original) and
    verified (whether that is the root). Cases as in ``proofs``; tampering leaves NULL texts NULL."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = proofs(docs, tampered(F.col("text"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("presented", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
