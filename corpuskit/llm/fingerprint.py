"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A text is the set of 64-bit digests of its paragraphs (lines; a long line is cut after a sentence end
about every ``PIECE`` characters). Every digest is added to one cell in each third of a table; a cell
holds a count, the exclusive-or of its digests and that of their checks. Tables of one size subtract
cell by cell: what two versions share cancels out. A cell left with one digest gives it away; taking
it out of its other cells uncovers more (peeling), until the table is empty and all digests that
differ are known, or nothing can be peeled: then both are sketched again in a larger table.

Everything happens inside a row with array functions: no shuffle, and work in proportion to the
paragraphs (entries are sorted by cell, one mark a cell, so each cell is a slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID

PIECE = 160
THIRD = 4  #: cells in each third of the fingerprint, and least of an attempt; a power of two
START = 1.3  #: cells of the first attempt for each digest of the two texts, at least
GROWTH = 2
ATTEMPTS = 12  #: the last one has over 2600 cells for each digest
ROUNDS = 24
_LOW = (1 << 32) - 1
_ITEMS = "array<struct<k:bigint,s:int,c:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """Distinct digests (long) of the paragraphs of ``text``; blank ones have none. NULL: none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}[^\n.!?]*[.!?]*"), F.lit(0))
    full = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(full, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(_LOW))


def signed(digests: Column) -> Column:
    """Digests as items (k, s, c): the digest, its side (1) and its check."""
    return F.transform(digests, lambda k: F.struct(k.alias("k"), F.lit(1).alias("s"), _check(k).alias("c")))


def _cell(n, k, c) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _empty() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def table(items: Column, third: Column) -> Column:
    """Cells (n, k, c) of a sketch of ``items``, three times ``third`` (a power of two up to 2^20). An
    item's cell in each third comes from other bits of one hash of its digest."""
    def build(items):
        def cells_of(x, i):
            return _let(F.xxhash64(x["k"]), lambda h: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.shiftleft(
                j * third + F.when(j == 0, h).when(j == 1, F.shiftrightunsigned(h, 21)).otherwise(F.shiftrightunsigned(h, 42)).bitwiseAND(
                    (third - 1).cast("long")), 32) + i + 1))

        entries = F.flatten(F.transform(items, cells_of))
        step = F.lit(1 << 32)
        marks = F.sequence(F.lit(0).cast("long"), F.shiftleft((third * 3 - 1).cast("long"), 32), step)

        def sliced(e):
            def cut(at):
                def fold(first, size):
                    added = lambda a, it: _cell(a["n"] + it["s"], a["k"].bitwiseXOR(it["k"]), a["c"].bitwiseXOR(it["c"]))
                    item = lambda x: F.get(items, (x.bitwiseAND(F.lit(_LOW)) - 1).cast("int"))
                    one = _let(item(F.element_at(e, first)), lambda it: _cell(it["s"], it["k"], it["c"]))
                    more = F.aggregate(F.slice(e, first, size), _empty(), lambda a, x: _let(item(x), lambda it: added(a, it)))
                    return F.when(size == 0, _empty()).when(size == 1, one).otherwise(more)

                return F.transform(at, lambda p, i: fold(p + 1, F.coalesce(F.get(at, i + 1), F.size(e) + 1) - p - 1))

            return _let(F.array_compact(F.transform(e, lambda x, i: F.when(x.bitwiseAND(F.lit(_LOW)) == 0, i + 1))), cut)

        return _let(F.sort_array(F.concat(marks, entries)), sliced)

    return _let(items, build)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(y["n"].cast("long").bitwiseOR(y["k"]).bitwiseOR(y["c"]) == 0, x).otherwise(
        _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"]))))


def peeled(diff: Column, third: Column) -> Column:
    """(items, done): digests that differ with their side (s = 1 first, -1 second), and whether the
    table came out empty."""
    state = F.struct(diff.alias("t"), F.array().cast(_ITEMS).alias("items"), F.lit(True).alias("live"))

    def step(a, _):
        def round_(pure):
            return F.struct(subtracted(a["t"], table(pure, third)).alias("t"), F.concat(a["items"], pure).alias("items"),
                            F.lit(True).alias("live"))

        def go(pure):
            stop = F.struct(a["t"].alias("t"), a["items"].alias("items"), F.lit(False).alias("live"))
            return F.when(F.size(pure) > 0, round_(pure)).otherwise(stop)

        pure = F.array_distinct(F.transform(
            F.filter(a["t"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))),
            lambda c: F.struct(c["k"].alias("k"), c["n"].alias("s"), c["c"].alias("c"))))
        return F.when(a["live"], _let(pure, go)).otherwise(a)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step)
    return _let(end, lambda e: F.struct(e["items"].alias("items"), F.forall(
        e["t"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)).alias("done")))


def difference(a: Column, b: Column) -> Column:
    """Items (k, s, c) of the digests in just one of the digest arrays ``a`` and ``b``, recovered from
    sketches. The first table mostly holds a difference of all digests; a failed peeling is retried in
    a table ``GROWTH`` times as large. Only should the largest fail too, the arrays are compared
    directly."""
    wanted = F.ceil(F.log2(F.greatest((F.size(a) + F.size(b)) * F.lit(START) / (3 * THIRD), F.lit(1.0)))).cast("int")
    none = F.struct(F.lit(None).cast(_ITEMS).alias("items"), (F.lit(THIRD) * F.pow(F.lit(2.0), wanted)).cast("int").alias("third"))

    def attempt(state, _):
        def tried(p):
            return F.struct(F.when(p["done"], p["items"]).alias("items"), (state["third"] * GROWTH).alias("third"))

        return F.when(state["items"].isNotNull(), state).otherwise(
            _let(peeled(subtracted(table(signed(a), state["third"]), table(signed(b), state["third"])), state["third"]), tried))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), none, attempt)["items"]
    direct = F.concat(signed(F.array_except(a, b)), F.transform(
        signed(F.array_except(b, a)), lambda x: F.struct(x["k"].alias("k"), F.lit(-1).alias("s"), x["c"].alias("c"))))
    return F.when(a == b, F.array().cast(_ITEMS)).otherwise(F.coalesce(found, direct))


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs over all paragraphs of the two, from the recovered difference; texts
    without paragraphs are alike."""
    total = F.size(a) + F.size(b)
    return _let(F.size(difference(a, b)), lambda d: F.when(total == 0, 1.0).otherwise((total - d) / (total + d)))


def fingerprint(digests: Column) -> Column:
    """Cells of the smallest sketch as text: count, digests and check of each in hexadecimal."""
    return F.array_join(F.transform(table(signed(digests), F.lit(THIRD)), lambda c: F.lower(F.concat(
        F.hex(c["n"].cast("long")), F.lit("-"), F.hex(c["k"]), F.lit("-"), F.hex(c["c"])))), ".")


# ------------------------------------------------------------------ the document after

RUN = 2000  #: about so many documents are put in order together


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) of every row: the text of the next row by descending doc_id, of
    the first after the last. NULL ids come last; equal ids go by the hash of their text; NULL text
    is empty. The order is cut into runs of ids, so no task sorts more than a run; only the first
    row of every run is joined to the run before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    span = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count(F.lit(1))).first()
    low, high, known, every = (x or 0 for x in span)
    width = max(1, -(-(high - low + 1) * RUN // max(known, 1)))
    # runs grow with the order: descending ids, then those without by the hash of their text
    last, nulls = (high - low) // width + 1, max(1, (every - known) // RUN)
    by_hash = F.xxhash64("text").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    spread = F.floor(by_hash * nulls / F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("long")
    run = F.when(F.col("doc_id").isNull(), F.lit(last) + spread).otherwise(F.floor((F.lit(high) - F.col("doc_id")) / width))
    rows = rows.withColumn("run", run.cast("long")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    w = Window.partitionBy("run").orderBy(*order)
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("at", F.row_number().over(w))
    # one row a run from here on
    key = F.struct(F.coalesce(-F.col("doc_id"), F.lit(LAST_ID)).alias("o"), F.col("h"))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = first.withColumn("run", run.cast("long")).withColumn("h", F.xxhash64("text"))
    heads = first.groupBy("run").agg(F.min_by("text", key).alias("head"))
    runs = heads.select("run", F.coalesce(F.lead("run").over(Window.orderBy("run")), F.min("run").over(Window.partitionBy())).alias("then"))
    after = runs.join(heads.withColumnRenamed("run", "then"), "then").select("run", "head")
    return (rows.join(after, "run").select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text")))


def compared(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or
    all) of the next document. Empty texts have no paragraphs and the empty sketch; a single row is
    its own next; an empty table gives an empty result.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"),
                      F.when(half > 0, F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))")).otherwise(""))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"), paragraphs(F.col("next_text")).alias("b"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
                       fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"),
                       likeness(F.col("a"), F.col("b")).alias("near_next"))
