"""Suffix-array dedup: maximal repeats of at least ``min_len`` bytes with all their occurrences.

A suffix array of the whole corpus does not fit one machine, and sorting every suffix moves the
corpus many times. Here only suffixes that can repeat are sorted, dealt so that equal
``min_len``-byte strings always meet:

Equal texts fold into one first, with their smallest doc_id; the others are copies as a whole.

1. Anchors. Every ``min_len``-byte window picks the gram with the smallest hash inside it
   (leftmost of equals), so equal windows pick equal grams. Windows in a row with the same anchor
   form one *stretch*. A pass over the texts gives each document's anchor hashes with a digest of
   the stretch, packed by bucket; the bucket tells which anchors stand in two documents or more.
   Where all stretches of an anchor are equal, its suffix array is that of one string, whose only
   maximal repeat is the string itself: the bucket answers at once, and later documents lose it.
   An anchor met often in one batch is not sent to its bucket row by row but taken as shared, so a
   passage of a third of all documents loads no bucket.
2. Stretches of the other shared anchors are cut out, and equal ones fold into one string with its
   smallest doc_id by partial aggregation.
3. The strings of one anchor form a generalised suffix array: suffixes of at least ``min_len``
   bytes are sorted, neighbours give the common-prefix lengths, and a stack scan walks the
   common-prefix interval tree. An interval whose members are preceded by different bytes (or
   begin a string) cannot be extended to the left: it is a maximal repeat, given with all members.
   Maximality is judged inside a stretch; a longer passage is a chain of overlapping repeats.
   An anchor with over ``hot`` different strings is settled per window by joins instead, so no
   task ever holds it whole.
4. Every string gets, per window, the smallest doc_id of the repeats that cover it; joined back to
   the occurrences this gives the bytes to remove.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, boxed, id_order, lean, shuffle_partitions, slices, written

MIN_LEN = 50
GRAM = 22
HOT = 50_000
#: Documents of one batch that make an anchor shared without asking its bucket.
OFTEN = 16
CHUNK = 1 << 19
#: Bytes of texts laid end to end, so that the arrays over them stay in a processor's cache.
LAID = 1 << 16
_POS = (1 << 21) - 1
_LOW48 = np.uint64((1 << 48) - 1)


# ------------------------------------------------------------------ anchors

_BASE = 0x9E3779B97F4A7C15


def _powers(x: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Polynomial hashes (modulo 2^64) of all strings of 1, 2, 4, ... up to ``most`` bytes."""
    h = {1: x.astype(np.uint64) + np.uint64(1)}
    size = 1
    while size * 2 <= most:
        n = len(x) - 2 * size + 1
        h[2 * size] = h[size][:n] * np.uint64(pow(_BASE, size, 1 << 64))
        h[2 * size] += h[size][size:size + n]
        size *= 2
    return h


def _hashes(powers: dict[int, np.ndarray], length: int, at=None) -> np.ndarray:
    """Mixed hash of the ``length``-byte strings at positions ``at`` (all of them if None)."""
    got, done, n = None, 0, len(powers[1]) - length + 1
    for size in sorted(powers, reverse=True):
        if length & size:
            part = powers[size][done:done + n] if at is None else powers[size][at + done]
            if got is None:
                got = part.copy()
            else:
                got *= np.uint64(pow(_BASE, size, 1 << 64))
                got += part
            done += size
    high = got >> np.uint64(31)
    got ^= high
    got *= np.uint64(0xBF58476D1CE4E5B9)
    got ^= np.right_shift(got, np.uint64(29), out=high)
    got *= np.uint64(0x94D049BB133111EB)
    got ^= np.right_shift(got, np.uint64(32), out=high)
    return got


def _sliding_min(k: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        k = np.minimum(k[:-size], k[size:])
        size *= 2
    rest = w - size
    return np.minimum(k[:-rest], k[rest:]) if rest else k


def stretches(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int, gram: int, digest: bool = False):
    """Stretches of the pieces ``x[starts[i]:ends[i]]``: first window, window after the last, the
    64-bit hash of the anchor, and with ``digest`` one of the stretch. No window crosses a piece."""
    n = len(x) - min_len + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    powers = _powers(x, min_len if digest else gram)
    h = _hashes(powers, gram)
    low = _sliding_min((h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64), min_len - gram + 1)
    edge = np.zeros(n + 1, np.int32)
    whole = ends - starts >= min_len
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - min_len + 1, -1)
    inside = np.cumsum(edge[:n]) > 0
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    at = np.nonzero(change)[0]
    stop = np.append(at[1:], n)
    keep = inside[at]
    at, stop = at[keep], stop[keep]
    d = None
    if digest:  # a stretch is shorter than two windows: its first and last one tell it all
        d = _hashes(powers, min_len, at) * np.uint64(3) + _hashes(powers, min_len, stop - 1) + (stop - at).astype(np.uint64)
    return at, stop, h[(low[at] & np.uint64(_POS)).astype(np.int64)], d


def _pieces(texts: list[bytes], min_len: int):
    """Texts laid end to end in chunks of about LAID bytes; a text of over CHUNK bytes is cut into pieces
    that overlap by ``min_len - 1`` bytes, so that each window stands in one piece.
    Yields bytes, starts, ends, number of the text, offset of the piece in its text."""
    held, size = [], 0

    def laid(held):
        lens = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(lens)
        return (np.frombuffer(b"".join(p for _, _, p in held), np.uint8), ends - lens, ends,
                np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held]))

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - min_len + 1), CHUNK):
            p = t[o:o + CHUNK + min_len - 1]
            if len(p) < min_len:
                continue
            held.append((i, o, p))
            size += len(p)
            if size >= LAID:
                yield laid(held)
                held, size = [], 0
    if held:
        yield laid(held)


DIGEST = 8  # bytes of a stretch's digest that are told: all of them, because equal ones answer for their strings


def _planes(h: np.ndarray, width: int = 6) -> bytes:
    """The low ``width`` bytes of each hash, byte plane by byte plane."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(b: bytes, width: int = 6) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.nonzero(np.concatenate(([True], x[1:] != x[:-1])))[0] if len(x) else np.zeros(0, np.int64)


def _parts(values: np.ndarray, at: np.ndarray):
    """Positions ``at`` grouped by their value, in the order they have."""
    by = at[np.argsort(values[at], kind="stable")]
    return [p for p in np.split(by, _runs(values[by])[1:]) if len(p)]


_ROWS = pa.schema([("bucket", pa.int32()), ("shared", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary()),
                   ("hashes", pa.binary()), ("digests", pa.binary())])


def _anchor_rows(min_len: int, gram: int, buckets: int):
    """Batches of (id, text) -> packed rows. Usual rows: ids, pairs of each, their hashes and
    digests. Rows that are ``shared`` pass the bucket: their hashes need no question. Rows without
    ids name hashes that other batches have as shared."""
    def run(batches):
        for whole in batches:
            docs, found, told, first = [], [], [], 0
            ids = whole.column("id").to_numpy()
            for part in slices(whole, "text", 8 * CHUNK):
                for x, starts, ends, number, _ in _pieces([b or b"" for b in part.column("text").to_pylist()], min_len):
                    at, _, h, d = stretches(x, starts, ends, min_len, gram, True)
                    docs.append(first + number[np.searchsorted(starts, at, side="right") - 1])
                    found.append(h)
                    told.append(d)
                first += part.num_rows
            if not docs:
                continue
            doc, h, d = np.concatenate(docs), np.concatenate(found), np.concatenate(told)
            order = np.lexsort((d, h, doc))
            doc, h, d = doc[order], h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            doc, h, d = doc[new], h[new], d[new]
            order = np.argsort(h, kind="stable")
            cut = _runs(h[order])
            size = np.diff(np.append(cut, len(h)))
            often = np.zeros(len(h), bool)
            often[order] = np.repeat(size >= OFTEN, size)
            lead = np.zeros(len(h), bool)
            lead[order[cut[size >= OFTEN]]] = True
            bucket = ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.int32)

            def packed(p):
                numbers, counts = np.unique(doc[p], return_counts=True)
                return ids[numbers].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _planes(h[p])

            rows = [(int(bucket[p[0]]), False, *packed(p), _planes(d[p], DIGEST)) for p in _parts(bucket, np.nonzero(~often)[0])]
            rows += [(int(bucket[p[0]]), False, b"", b"", _planes(h[p]), b"") for p in _parts(bucket, np.nonzero(lead)[0])]
            salt = (ids[doc] % buckets).astype(np.int32)
            rows += [(int(salt[p[0]]), True, *packed(p), b"") for p in _parts(salt, np.nonzero(often)[0])]
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)}, schema=_ROWS)

    return run


def _answers(fold: bool):
    """Buckets -> (id, gone, shared): hashes of anchors whose only stretch an earlier document has,
    and of anchors with several different stretches (all that repeat, unless ``fold``)."""
    def spread(i, c):
        return np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4"))

    def done(rows):
        asked = [r for r in rows if r[0]]
        if not asked:
            return
        ids = np.concatenate([spread(i, c) for i, c, _, _ in asked])
        h = np.concatenate([_unplaned(x) for _, _, x, _ in asked])
        d = np.concatenate([_unplaned(x, DIGEST) for _, _, _, x in asked])
        order = np.argsort(h, kind="stable")
        ids, h, d = ids[order], h[order], d[order]
        cut = _runs(h)
        size = np.diff(np.append(cut, len(h)))
        least = np.minimum.reduceat(ids, cut)
        marked = np.isin(h[cut], np.concatenate([_unplaned(x) for i, _, x, _ in rows if not i] or [np.zeros(0, np.uint64)]))
        again = marked | (least != np.maximum.reduceat(ids, cut))
        several = again & (marked | (np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)) | (not fold))
        shared = np.repeat(several, size)
        gone = np.repeat(again & ~several, size) & (ids > np.repeat(least, size))
        yield from told(ids[gone], h[gone], ids[shared], h[shared])

    def told(gone_ids, gone, shared_ids, shared):
        ids = np.concatenate((gone_ids, shared_ids))
        kind = np.repeat([0, 1], [len(gone), len(shared)])
        h = np.concatenate((gone, shared)).astype("<u8")
        for p in _parts(ids, np.arange(len(ids))):
            yield int(ids[p[0]]), h[p[kind[p] == 0]].tobytes(), h[p[kind[p] == 1]].tobytes()

    def batch(rows):
        cols = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                                           pa.array(cols[2], pa.binary())], ["id", "gone", "shared"])

    def run(batches):
        held, bucket, none = [], None, np.zeros(0, np.uint64)
        for b in batches:
            for k, shared, i, c, h, d in zip(*[col.to_pylist() for col in b.columns]):
                if shared:
                    yield batch(told(none.astype(np.int64), none, spread(i, c), _unplaned(h)))
                    continue
                if k != bucket and held:
                    yield batch(done(held))
                    held = []
                bucket = k
                held.append((i, c, h, d))
        if held:
            yield batch(done(held))

    return run


def repeated_anchors(rows: DataFrame, min_len: int, gram: int, fold: bool = True) -> DataFrame:
    """``rows`` (id long, text binary) -> (id, gone, shared): arrays of packed anchor hashes (eight
    bytes each, 48 bits) of every document that has an anchor standing in two documents or more."""
    n = min(shuffle_partitions(rows), 1 << 16)
    kinds = "bucket int, shared boolean, ids binary, counts binary, hashes binary, digests binary"
    found = (rows.mapInArrow(lean(_anchor_rows(min_len, gram, n)), kinds).repartition(n, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(lean(_answers(fold)), "id long, gone binary, shared binary"))
    return found.groupBy("id").agg(F.collect_list("gone").alias("gone"), F.collect_list("shared").alias("shared"))


# ------------------------------------------------------------------ strings of the stretches

_WHERE = "anchor long, name long, id long, sha binary, start long"


def _name(s: bytes) -> int:
    """Names a string among those of its anchor (a signed 64-bit hash)."""
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _strings(min_len: int, gram: int, occurrences: bool):
    """Documents with their repeated anchors -> strings (anchor, s, id), or occurrences
    (anchor, name of the string, id, sha, start)."""
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 4 * CHUNK):
                ids, keys = b.column("id").to_pylist(), b.column("sha").to_pylist()
                wanted = [np.frombuffer(b"".join(h), "<u8") for h in b.column("shared").to_pylist()]
                out = [[], [], [], [], []]
                for x, starts, ends, number, offset in _pieces(b.column("text").to_pylist(), min_len):
                    at, stop, h, _ = stretches(x, starts, ends, min_len, gram)
                    piece = np.searchsorted(starts, at, side="right") - 1
                    cuts = np.searchsorted(piece, np.arange(len(starts) + 1))
                    data = x.tobytes()
                    for p in range(len(starts)):
                        lo, hi = cuts[p], cuts[p + 1]
                        row = number[p]
                        some = lo + np.nonzero(np.isin(h[lo:hi] & _LOW48, wanted[row]))[0]
                        cut = [data[a:z] for a, z in zip(at[some].tolist(), (stop[some] + min_len - 1).tolist())]
                        out[0] += h[some].view(np.int64).tolist()
                        if occurrences:
                            out[4] += [_name(s) for s in cut]
                            out[3] += (at[some] - starts[p] + offset[p]).tolist()
                        else:
                            out[3] += cut
                        out[1] += [ids[row]] * len(cut)
                        if occurrences:
                            out[2] += [keys[row]] * len(cut)
                if occurrences:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[1], pa.int64()),
                                                      pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())],
                                                     ["anchor", "name", "id", "sha", "start"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[3], pa.binary()),
                                                      pa.array(out[1], pa.int64())], ["anchor", "s", "id"])

    return run


# ------------------------------------------------------------------ enhanced suffix array

def _met_again(strings: list[bytes], min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (number of the string, offset) whose first ``min_len`` bytes have the hash of another's:
    all that can share them."""
    lens = np.array([len(s) for s in strings])
    count = lens - min_len + 1
    owner = np.repeat(np.arange(len(strings)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = _hashes(_powers(np.frombuffer(b"".join(strings), np.uint8), min_len), min_len)[(np.cumsum(lens) - lens)[owner] + offset]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return owner[again], offset[again]


def suffix_array(strings: list[bytes], min_len: int, some: tuple[np.ndarray, np.ndarray] | None = None):
    """Suffixes of at least ``min_len`` bytes (all, or ``some``) in order: number of the string, offset,
    length, and the common-prefix length with the suffix before (0 for the first)."""
    lens = np.array([len(s) for s in strings])
    count = lens - min_len + 1
    if some is None:
        owner = np.repeat(np.arange(len(strings)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    else:
        owner, offset = some
    left = lens[owner] - offset
    wide = -(-int(lens.max()) // 8) * 8
    data = np.frombuffer(b"".join(strings) + bytes(wide), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, wide)[(np.cumsum(lens) - lens)[owner] + offset].copy()
    rows[np.arange(wide)[None, :] >= left[:, None]] = 0
    order = np.argsort(left, kind="stable")
    order = order[np.argsort(rows[order].view(f"S{wide}").ravel(), kind="stable")]
    owner, offset, left, rows = owner[order], offset[order], left[order], rows[order]
    lcp = np.zeros(len(owner), np.int64)
    differs = rows[1:] != rows[:-1]
    first = np.where(differs.any(1), differs.argmax(1), wide)
    lcp[1:] = np.minimum(first, np.minimum(left[1:], left[:-1]))
    return owner, offset, left, lcp


def lcp_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of depth ``least`` or more, by a stack scan."""
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i - 1))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def maximal_repeats_of(strings: list[bytes], min_len: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of ``strings``: (length, string numbers, offsets) of all members."""
    if len(strings) < 2:
        return []
    some = _met_again(strings, min_len)
    if not len(some[0]):
        return []
    owner, offset, _, lcp = suffix_array(strings, min_len, some)
    inner = lcp >= min_len
    if not inner.any():
        return []
    before = np.full(len(owner), -1)
    has = np.nonzero(offset > 0)[0]
    lens = np.array([len(s) for s in strings])
    before[has] = np.frombuffer(b"".join(strings), np.uint8)[(np.cumsum(lens) - lens)[owner[has]] + offset[has] - 1]
    edge = np.diff(np.concatenate(([0], inner.astype(np.int8), [0])))
    found = []
    for a, z in zip((np.nonzero(edge == 1)[0] - 1).tolist(), np.nonzero(edge == -1)[0].tolist()):
        # suffixes a .. z-1 share min_len bytes or more; scan their part of the tree
        tree = [(int(lcp[a + 1]), 0, 1)] if z - a == 2 else lcp_intervals([0, *lcp[a + 1:z].tolist()], min_len)
        for depth, first, last in tree:
            b = before[a + first:a + last + 1]
            if b.min() < 0 or b.min() != b.max():
                found.append((depth, owner[a + first:a + last + 1], offset[a + first:a + last + 1]))
    return found


def _groups(min_len: int, emit):
    """Sorted strings (anchor, s, ...) -> ``emit`` of all strings of as many whole anchors as
    make about 256 KB."""
    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[0] != last and size >= 1 << 18:
                    yield emit(held)
                    held, size = [], 0
                last = row[0]
                size += len(row[1])
                held.append(row)
        if held:
            yield emit(held)

    return run


def _shared(held: list) -> list[int]:
    """Positions of strings whose anchor has another string."""
    return [i for i, r in enumerate(held) if (i and held[i - 1][0] == r[0]) or (i + 1 < len(held) and held[i + 1][0] == r[0])]


def _verdicts(min_len: int):
    """Per string, runs of windows with the smallest id of the repeats that cover them."""
    def emit(held):
        ids, count = np.array([r[2] for r in held], np.int64), np.array([len(r[1]) - min_len + 1 for r in held])
        at = np.cumsum(count) - count
        own = np.repeat(ids, count)
        low = own.copy()
        shared = np.array(_shared(held), np.int64)
        for depth, owner, offset in maximal_repeats_of([held[i][1] for i in shared.tolist()], min_len):
            least, begin = ids[shared[owner]].min(), at[shared[owner]] + offset
            for k in begin.tolist():
                part = low[k:k + depth - min_len + 1]
                np.minimum(part, least, out=part)
        # a string that stands in one text, and of which no other covers any, has no verdict
        told = np.logical_or.reduceat(low != own, at) | (np.array([r[3] for r in held]) != 1)
        begin = np.ones(len(low), bool)
        begin[1:] = low[1:] != low[:-1]
        begin[at] = True
        owner = np.repeat(np.arange(len(held)), count)
        begin = np.nonzero(begin)[0]
        end = np.append(begin[1:], len(low))
        keep = told[owner[begin]]
        begin, end = begin[keep], end[keep]
        owner = owner[begin]
        fields = [pa.array((begin - at[owner]).astype(np.int32)), pa.array((end - at[owner]).astype(np.int32)), pa.array(low[begin])]
        some = np.nonzero(told)[0]
        edges = np.searchsorted(owner, np.append(some, len(held))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, ["a", "z", "least"]))
        anchors, names = [held[i][0] for i in some.tolist()], [_name(held[i][1]) for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(names, pa.int64()), runs],
                                          ["anchor", "name", "runs"])

    return _groups(min_len, emit)


_RUNS = "anchor long, name long, runs array<struct<a:int,z:int,least:bigint>>"


def _split_hot(strings: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    many = strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("anchor")
    return strings.join(many, "anchor", "left_anti"), strings.join(many, "anchor", "left_semi")


def _hot_verdicts(strings: DataFrame, min_len: int) -> DataFrame:
    """Verdicts of anchors with very many strings, window by window: routed by content."""
    @F.pandas_udf("long")
    def name(s):
        return s.map(_name)

    each = (strings.select("anchor", "s", "id", F.explode(F.sequence(F.lit(0), F.length("s") - min_len)).alias("a"))
            .select("anchor", "s", "id", "a", F.expr(f"substring(s, a + 1, {min_len})").alias("window")))
    least = each.groupBy("window").agg(F.min("id").alias("least"))
    run = F.struct(F.col("a").cast("int").alias("a"), (F.col("a") + 1).cast("int").alias("z"), "least")
    return (each.join(least, "window").groupBy("anchor", "s").agg(F.collect_list(run).alias("runs"))
            .select("anchor", name("s").alias("name"), "runs"))


# ------------------------------------------------------------------ operator

def _unlisted(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which list each item is of, and the items of all lists."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), pc.list_flatten(lists)


def _rows(docs: DataFrame) -> DataFrame:
    """(id, sha, text): ``id`` orders documents (NULL last), ``sha`` (16 bytes) names the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(id_order().alias("id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("sha"), text.alias("text"))


def _first_of_texts(rows: DataFrame) -> DataFrame:
    """(sha, first): the smallest id of each text."""
    return rows.groupBy("sha").agg(F.min("id").alias("first"))


def _flagged(rows: DataFrame, min_len: int, gram: int, fold: bool = True) -> DataFrame:
    """(id, sha, text, gone, shared) of the first document of each text that has anchors to look
    at; each once, written."""
    anchors = written(repeated_anchors(rows.select("id", "text"), min_len, gram, fold), "anchors")
    # rows equal in id and text are counted, so that only they are folded with their text
    again = rows.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    first = again.groupBy("sha").agg(F.min(F.struct("id", "n")).alias("f")).select("sha", "f.*")
    found = rows.join(first.join(anchors, "id"), ["sha", "id"])
    rest = [c for c in found.columns if c != "n"]
    return written(found.filter("n = 1").select(rest).unionByName(found.filter("n > 1").select(rest).dropDuplicates(["id", "sha"])),
                   "flagged")


def removals(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """First documents of their texts that lose bytes -> (id, sha, kept binary, n_removed long,
    n_spans long); ``id`` and ``sha`` are those of ``_rows``.

    A byte goes if a ``min_len``-byte string that covers it also starts in a document with a
    smaller doc_id (NULL ids come last and are equal among themselves).
    """
    if not 1 <= gram <= min_len:
        raise ValueError("gram must lie between 1 and min_len")
    flagged = _flagged(_rows(docs), min_len, gram)
    strings = written(flagged.mapInArrow(lean(_strings(min_len, gram, False)), "anchor long, s binary, id long")
                      .groupBy("anchor", "s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "strings")
    usual, many = _split_hot(strings, hot)
    verdict = (usual.repartition("anchor").sortWithinPartitions("anchor", "s").mapInArrow(lean(_verdicts(min_len)), _RUNS)
               .unionByName(_hot_verdicts(many, min_len)))
    where = flagged.mapInArrow(lean(_strings(min_len, gram, True)), _WHERE)
    smaller = (where.join(verdict, ["anchor", "name"])
               .select("id", "sha", "start", F.filter("runs", lambda r: r["least"] < F.col("id")).alias("runs"))
               .filter(F.size("runs") > 0))
    cuts = written(smaller.groupBy("id", "sha").agg(F.collect_list(F.struct("start", "runs")).alias("cuts")), "cuts")

    def cut(batches):
        for whole in batches:
            for b in slices(whole, "text", 4 * CHUNK):
                texts = b.column("text").to_pylist()
                size = np.array([len(t) + 1 for t in texts])
                base = np.cumsum(size) - size
                edge = np.zeros(int(size.sum()), np.int32)  # of all texts in a row
                gone = [np.frombuffer(b"".join(g), "<u8") for g in b.column("gone").to_pylist()]
                # only texts that lose whole stretches are asked for theirs
                for x, starts, ends, number, offset in _pieces([t if len(g) else b"" for t, g in zip(texts, gone)], min_len):
                    at, stop, h, _ = stretches(x, starts, ends, min_len, gram)
                    piece = np.searchsorted(starts, at, side="right") - 1
                    cuts = np.searchsorted(piece, np.arange(len(starts) + 1))
                    for p in range(len(starts)):
                        row, lo, hi = number[p], cuts[p], cuts[p + 1]
                        some = lo + np.nonzero(np.isin(h[lo:hi] & _LOW48, gone[row]))[0]
                        here = base[row] + offset[p] - starts[p]
                        np.add.at(edge, at[some] + here, 1)
                        np.add.at(edge, stop[some] + here + min_len - 1, -1)
                of_text, found = _unlisted(b.column("cuts"))
                of_found, runs = _unlisted(pc.struct_field(found, "runs"))
                here = (base[of_text] + pc.struct_field(found, "start").to_numpy(zero_copy_only=False))[of_found]
                np.add.at(edge, here + pc.struct_field(runs, "a").to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, here + pc.struct_field(runs, "z").to_numpy(zero_copy_only=False) - 1 + min_len, -1)
                edge = np.cumsum(edge) > 0
                lost = [edge[x:x + n - 1] for x, n in zip(base.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("sha"), pa.array([np.frombuffer(t, np.uint8)[~g].tobytes() for t, g in zip(texts, lost)], pa.binary()),
                     pa.array([int(g.sum()) for g in lost], pa.int64()),
                     pa.array([int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) for g in lost], pa.int64())],
                    ["id", "sha", "kept", "n_removed", "n_spans"])

    rows = flagged.select("id", "sha", "text", "gone").join(cuts, ["id", "sha"], "left").select("id", "sha", "text", "gone", "cuts")
    return rows.mapInArrow(lean(cut), "id long, sha binary, kept binary, n_removed long, n_spans long").filter("n_removed > 0")


def repeat_groups(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """Maximal repeat groups with all their occurrences: (repeat binary, length int, doc_id long,
    start long), ``repeat`` naming the repeated bytes. Maximal inside a stretch (see the module)."""
    rows = _rows(docs)
    flagged = _flagged(rows, min_len, gram, False)
    strings = (flagged.mapInArrow(lean(_strings(min_len, gram, False)), "anchor long, s binary, id long")
               .groupBy("anchor", "s").agg(F.count(F.lit(1)).alias("n")))

    def emit(held):
        out = [(xxhash.xxh3_128_digest(s), len(s), a, _name(s), 0) for a, s, n in held if n > 1]
        shared = _shared(held)
        texts = [held[i][1] for i in shared]
        for depth, owner, offset in maximal_repeats_of(texts, min_len):
            repeat = xxhash.xxh3_128_digest(texts[owner[0]][offset[0]:offset[0] + depth])
            out += [(repeat, depth, held[shared[o]][0], _name(texts[o]), k) for o, k in zip(owner.tolist(), offset.tolist())]
        cols = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())],
                                          ["repeat", "length", "anchor", "name", "at"])

    groups = (strings.repartition("anchor").sortWithinPartitions("anchor", "s")
              .mapInArrow(_groups(min_len, emit), "repeat binary, length int, anchor long, name long, at int"))
    where = flagged.mapInArrow(lean(_strings(min_len, gram, True)), _WHERE)
    # equal texts have the repeats of their first document
    every = groups.join(where, ["anchor", "name"]).join(rows.select("sha", F.col("id").alias("own")), "sha")
    real = F.when(F.col("own") < LAST_ID, F.col("own"))
    return every.select("repeat", "length", real.alias("doc_id"), (F.col("start") + F.col("at")).alias("start")).distinct()


def _copy(min_len: int):
    """Whether a row is a copy of a text with a smaller id, long enough to lose all of it."""
    return (F.col("id") > F.col("first")) & (F.col("n_bytes") >= min_len)


def keep_first_copies(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. NULL text is empty; repeated rows
    each get their result; texts below ``min_len`` bytes and an empty table lose nothing."""
    found = written(removals(docs, min_len).select("id", "sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "removals")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select("doc_id", id_order().alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    base = base.withColumn("sha", F.substring(F.unhex("whole"), 1, 16))
    zero = F.lit(0).cast("long")
    return (base.join(_first_of_texts(_rows(docs)), "sha").join(found, ["id", "sha"], "left")
            .select("doc_id", "n_bytes",
                    F.when(_copy(min_len), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
                    F.when(_copy(min_len), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
                    F.when(_copy(min_len), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256")))


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (a character cut in two goes with
    them) and ``n_chars``, where there is one, counted anew; all rows and columns stay."""
    @F.pandas_udf("string")
    def decode(kept):
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    found = written(removals(docs, min_len).select("id", "sha", decode("kept").alias("kept")), "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(boxed(docs).alias("whole"), id_order().alias("id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("sha"),
                        F.octet_length(text).alias("n_bytes"))
    out = keyed.join(_first_of_texts(_rows(docs)), "sha").join(found, ["id", "sha"], "left")
    out = out.select("whole", F.when(_copy(min_len), F.lit("")).otherwise(F.col("kept")).alias("new"))
    fields = {"text": F.coalesce("new", "whole.text")}
    if "n_chars" in docs.columns:
        count = F.char_length("new").cast(docs.schema["n_chars"].dataType)
        fields["n_chars"] = F.when(F.col("new").isNotNull(), count).otherwise(F.col("whole.n_chars"))
    return out.select(*[fields.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


#: DuckDB twin of ``keep_first_copies`` over ``documents``: every window of 50 bytes, in hexadecimal.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * MIN_LEN}) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - {MIN_LEN - 1}, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_LEN} THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {MIN_LEN} AS z FROM k GROUP BY ALL),
t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last FROM s GROUP BY doc_id),
parts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM s
          UNION ALL SELECT doc_id, last, n FROM t JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS h FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)"""
