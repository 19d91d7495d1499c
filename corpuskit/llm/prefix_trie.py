"""Trie of conversation prefixes, from composable fingerprints.

A sequence of turns has a fingerprint (value, power) of a monoid: the value is the sum of v(turn i) *
base^i modulo a prime, the power is base^length, and (x, a) followed by (y, b) is (x + a y, a b). Three
primes below 2^31 are used side by side. Prefix values of every stored conversation are running sums.
A rebuilt conversation is a head of one stored conversation and a suffix of another, so the fingerprints
of all its prefixes follow from stored values by a product; its turns are never copied, each prefix
only names the stored turn it ends with.

Prefixes of one length and fingerprint are a node. Equality is then verified: all members of a node
have their parent prefix in one node, and the stored turns they end with are compared as texts with the
node's own. If any differ, everything is done again with other bases.

Sums over subtrees use doubling: a node passes its sum on to its ancestor at distance 1, 2, 4 ..., so
the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
import random
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .numbering import numbered, running

#: The three largest primes below 2^31: products of two residues fit a long.
MODULI = (2147483647, 2147483629, 2147483587)
#: Conversations of a family share the head of its first one; heads have fewer turns than this.
FAMILY, HEADS = 5, 9
#: Ids joined to one string before they are hashed.
BLOCK = 1024
#: Bits of a position looked up at a time, and how often.
DIGIT, DIGITS = 5, 7
ATTEMPTS = 8

PARTS = range(len(MODULI))


def bases(seed: int) -> list[int]:
    r = random.Random(seed)
    return [r.randrange(1 << 20, p - 1) for p in MODULI]


def _product(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a * b, F.lit(p).cast("long"))


def _power(base: int, n: Column, p: int) -> Column:
    """base^n modulo p, by the digits of n."""
    tables = [F.array(*[F.lit(pow(base, k << (DIGIT * j), p)).cast("long") for k in range(1 << DIGIT)]) for j in range(DIGITS)]
    parts = [F.get(t, F.shiftright(n, DIGIT * j).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")) for j, t in enumerate(tables)]
    return reduce(lambda x, y: _product(x, y, p), parts)


def _residues(name: str) -> list[str]:
    return [f"{name}{k}" for k in PARTS]


def _key(name: str) -> Column:
    return F.struct(*[F.col(c) for c in _residues(name)])


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


# ------------------------------------------------------------------ stored turns

def stored_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv, turn, role, text, ref, written once. Rows
    without conv_id belong to no conversation; NULL roles and texts become empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                empty("role").alias("role"), empty("text").alias("text")).filter("conv IS NOT NULL")
    return written(rows.withColumn("ref", F.monotonically_increasing_id()), "turns", collect=False)


def _positions(stored: DataFrame) -> DataFrame:
    """conv, part, pos (from 1), n (turns of the conversation), ref, bytes."""
    placed = numbered(stored.withColumn("bytes", F.octet_length("text").cast("long")), ["conv"], ["turn", "role", "text"], part="part")
    return placed.select("conv", "part", "idx", (F.col("idx") + 1).alias("pos"), F.col("total").alias("n"), "ref", "bytes")


def _values(stored: DataFrame, placed: DataFrame, seed: int) -> DataFrame:
    """Positions with s0, s1, s2, the values of the prefix that ends here, and r0, r1, r2, of the one before."""
    hashed = stored.select("ref", *[F.pmod(F.xxhash64(F.lit(len(MODULI) * seed + k), "role", "text"), F.lit(p - 1)).alias(f"v{k}")
                                    for k, p in enumerate(MODULI)])
    terms = placed.join(hashed, "ref").select(*placed.columns, *[
        _product(F.col(f"v{k}") + 1, _power(b, F.col("pos"), p), p).alias(f"t{k}") for k, (b, p) in enumerate(zip(bases(seed), MODULI))])
    summed = running(written(terms, "terms", collect=False), ["conv"], _residues("t"))
    return summed.select("conv", "pos", "n", "ref", "bytes",
                         *[F.pmod(f"t{k}_upto", F.lit(p)).alias(f"s{k}") for k, p in enumerate(MODULI)],
                         *[F.pmod(F.col(f"t{k}_upto") - F.col(f"t{k}"), F.lit(p)).alias(f"r{k}") for k, p in enumerate(MODULI)])


# ------------------------------------------------------------------ rebuilt conversations

def _rebuilt(own: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """own (conv, pos, n, ref, bytes, s*, r*) -> (prefixes, lengths).

    prefixes: conv, depth, f* (fingerprint), g* (of the prefix one shorter), ref and bytes of its last
    turn. lengths: conv, size (turns of the rebuilt conversation), f* of the whole."""
    convs = own.filter("pos = 1").select("conv", "n", head_length(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    heads = own.filter(F.col("pos") < HEADS).select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("pos").alias("depth"),
                                                    "ref", "bytes", *_residues("s"), *_residues("r"))
    shared = (convs.join(heads, "base").filter("depth <= h")
              .select("conv", "depth", *[F.col(f"s{k}").alias(f"f{k}") for k in PARTS], *[F.col(f"r{k}").alias(f"g{k}") for k in PARTS], "ref", "bytes", "base_n"))
    # the two factors of every conversation: its head, and what to take off its own values
    none = [F.lit(0).cast("long").alias(f"f{k}") for k in PARTS]
    last = shared.filter(F.col("depth") == F.least(head_length(F.col("conv")), F.col("base_n"))).select("conv", F.col("depth").alias("head"), *_residues("f"))
    cut = own.filter(F.col("pos") == head_length(F.col("conv"))).select("conv", *[F.col(f"s{k}").alias(f"c{k}") for k in PARTS])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    factors = (convs.join(last, "conv", "left").join(cut, "conv", "left")
               .select("conv", "n", "h", zero("head").alias("head"), *[zero(c).alias(c) for c in (*_residues("f"), *_residues("c"))]))

    def after_head(value: str, k: int) -> Column:
        """Head times own suffix: the suffix moves from position h + 1 to head + 1."""
        base, p = bases(seed)[k], MODULI[k]
        back = F.array(*[F.lit(pow(base, -j, p)).cast("long") for j in range(HEADS)])
        moved = _product(F.pmod(F.col(f"{value}{k}") - F.col(f"c{k}"), F.lit(p)), F.get(back, (F.col("h") - F.col("head")).cast("int")), p)
        return F.pmod(F.col(f"f{k}") + moved, F.lit(p))

    suffixes = own.filter(F.col("pos") > head_length(F.col("conv"))).drop("n").join(factors, "conv").select(
        "conv", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), *[after_head("s", k).alias(f"f{k}") for k in PARTS],
        *[after_head("r", k).alias(f"g{k}") for k in PARTS], "ref", "bytes", (F.col("pos") == F.col("n")).alias("last"))
    # where conversations end: after their own last turn, after the head, or before any turn
    ends = suffixes.filter("last").select("conv", F.col("depth").alias("size"), *_residues("f")).unionByName(
        factors.filter("n <= h").select("conv", F.col("head").alias("size"), *[F.when(F.col("head") > 0, F.col(f"f{k}")).otherwise(n).alias(f"f{k}")
                                                                              for k, n in enumerate(none)]))
    return shared.drop("base_n").unionByName(suffixes.drop("last")), ends


def _nodes(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """depth, f, conv (smallest member), ref (its last turn), bytes, n_convs, g (parent), one_parent."""
    nodes = prefixes.select("conv", "depth", "ref", "bytes", _key("f").alias("f"), _key("g").alias("g")).groupBy("depth", "f").agg(
        F.min(F.struct("conv", "ref", "bytes", "g")).alias("own"), F.count(F.lit(1)).alias("n_convs"),
        (F.min("g") == F.max("g")).alias("one_parent"))
    nodes = nodes.select("depth", "f", "own.*", "n_convs", "one_parent")
    origin = F.struct(*[F.lit(0).cast("long").alias(c) for c in _residues("f")])
    root = ends.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), origin.alias("f"), "conv", F.lit(None).cast("long").alias("ref"), F.lit(0).cast("long").alias("bytes"),
        F.lit(None).cast(nodes.schema["g"].dataType).alias("g"), "n_convs", F.lit(True).alias("one_parent"))
    return root.unionByName(nodes)


def _unequal(stored: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> int:
    """Nodes whose members have several parents, and pairs of stored turns that end prefixes of one
    node and differ in role or text."""
    split = nodes.filter("NOT one_parent").count()
    if split:
        return split
    first = nodes.filter("depth > 0").select("depth", "f", F.col("ref").alias("own_ref"))
    pairs = (prefixes.select("depth", _key("f").alias("f"), "ref").join(first, ["depth", "f"])
             .filter("ref <> own_ref").select("ref", "own_ref").distinct())
    a = stored.select("ref", F.col("role").alias("role_a"), F.col("text").alias("text_a"))
    b = stored.select(F.col("ref").alias("own_ref"), F.col("role").alias("role_b"), F.col("text").alias("text_b"))
    return pairs.join(a, "ref").join(b, "own_ref").filter("role_a <> role_b OR text_a <> text_b").count()


def verified_nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends), equal in all turns and not only in fingerprint."""
    stored = stored_turns(conversations)
    placed = written(_positions(stored), "positions", collect=False)
    for seed in range(ATTEMPTS):
        own = written(_values(stored, placed, seed), "values", collect=False)
        prefixes, ends = (written(x, name, collect=False) for x, name in zip(_rebuilt(own, seed), ("prefixes", "ends")))
        nodes = written(_nodes(prefixes, ends), "nodes", collect=False)
        if not _unequal(stored, prefixes, nodes):
            return nodes, ends
    raise RuntimeError(f"fingerprints of unequal prefixes met under {ATTEMPTS} sets of bases")


# ------------------------------------------------------------------ sums and digests

def _subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (conv, depth, up: the parent's conv, sums) -> conv, depth, and each sum over the subtree."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, distance = nodes.select("conv", "depth", "up", *sums), 1
    while distance <= deepest:
        if distance > 1:
            state = written(state, "sums", collect=False)
        far = state.filter(F.col("depth") >= distance).select(F.col("conv").alias("up"), (F.col("depth") + distance).alias("depth"), F.col("up").alias("__up"))
        # a node keeps its sum and hands it to the ancestor it points at; then it points twice as far
        moved = state.join(far, ["up", "depth"], "left").select("conv", "depth", F.col("__up").alias("up"), *sums)
        given = state.filter(F.col("depth") >= distance).select(F.col("up").alias("conv"), (F.col("depth") - distance).alias("depth"),
                                                                F.lit(None).cast("long").alias("up"), *sums)
        state = moved.unionByName(given).groupBy("conv", "depth").agg(F.max("up").alias("up"), *[F.sum(c).alias(c) for c in sums])
        distance *= 2
    return state.drop("up")


def _end_digests(ends: DataFrame) -> DataFrame:
    """ends (conv, size, f*) -> depth, f, ends_sha256: of the ids, ascending, joined by commas.

    Ids are numbered inside their node and joined ``BLOCK`` at a time in parallel; a hash has to run
    over a node's blocks one after the other, which streams through them and holds only one."""
    keyed = ends.select(F.col("size").alias("depth"), *_residues("f"), "conv")
    group = ["depth", *_residues("f")]
    blocks = (numbered(keyed, group, ["conv"]).groupBy(*group, F.floor(F.col("idx") / BLOCK).alias("block"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    dealt = (blocks.select(F.to_json(F.array(*group)).alias("node"), *group, "block", "ids")
             .repartition(shuffle_partitions(ends), "node").sortWithinPartitions("node", "block"))

    def run(batches):
        at, key, state = None, None, None
        for batch in batches:
            out = []
            names, ids = batch.column("node").to_pylist(), batch.column("ids").to_pylist()
            keys = list(zip(*[batch.column(c).to_pylist() for c in group]))
            for name, k, text in zip(names, keys, ids):
                if name != at:
                    if at is not None:
                        out.append((*key, state.hexdigest()))
                    at, key, state = name, k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield arrow(out)
        if at is not None:
            yield arrow([(*key, state.hexdigest())])

    def arrow(rows):
        columns = list(zip(*rows)) or [()] * (len(group) + 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*group, "ends_sha256"])

    hashed = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in group) + ", ends_sha256 string")
    return hashed.select("depth", _key("f").alias("f"), "ends_sha256")


NOTHING = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id (NULL at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, NULL first; those that share one go by role, then text, and repeated rows are
    turns of their own. Rows without conv_id are left out; a remainder has the sign of its id. A
    conversation without turns is a member of the root alone. An empty table gives no rows. Columns
    other than conv_id, turn, role and text are not read.
    """
    nodes, ends = verified_nodes(conversations)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("g"), F.col("conv").alias("up"))
    linked = written(nodes.select("depth", "f", "conv", "bytes", "n_convs", "g").join(above, ["depth", "g"], "left")
                     .select("conv", "depth", "f", "up", "n_convs", "bytes"), "linked", collect=False)
    children = linked.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    weighed = written(linked.join(children, ["conv", "depth"], "left").select(
        "conv", "depth", "f", "up", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "weighed", collect=False)
    sums = _subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    return (weighed.drop("n_leaves", "saved_tokens").join(sums, ["conv", "depth"]).join(_end_digests(ends), ["depth", "f"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
