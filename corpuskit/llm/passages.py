"""Substring dedup by compact windows: near-duplicate passages of at least ``least`` words.

A text is a sequence of tokens (hashes of ``SHINGLE`` words). Under one hash function the Cartesian
tree of the token hashes groups its subsequences: the node at ``c`` with range [l, r] holds the
min-hash of all subsequences that begin in [l, c] and end in [c, r] - a compact window. Only nodes
whose range has ``least`` words matter: about 2 n / least for each of ``HASHES`` functions, found by a
sliding minimum.

1. A pass over the texts packs the min-hash and place of every compact window by bucket. A bucket
   answers each window with the first document that has the same min-hash (its representative), so a
   passage of any number of documents gives one link each, never all pairs; windows met often in one
   batch are answered there, against the first document of the batch, and only that one is sent on.
2. A representative of one min-hash need not have the passage: a common line is enough. So the same
   pass also names subsequences by several functions together (``JOINTS``; as many names as compact
   windows, each from one place to the next at which one of the min-hashes changes), and buckets answer
   these alike. All functions together name an exact passage, so the first document with the name has
   it; three together are shared by near-duplicates, but also by texts that have only a part of the
   passage. So such a window brings some bits of its min-hash under each other function (its signs). Where
   these differ, it is also answered with all documents of a small group, and in a larger one with the
   first document of each choice of equal signs. Within a batch, only equal signs are answered.
3. Interval join: in every document, the windows that point to one representative at about one
   distance are laid over each other; where the windows of ``AGREE`` or more hash functions hold the
   same subsequence, or one name of several functions does, it is a candidate with its counterpart.
4. Candidates meet the text of their representative and are verified: exact Jaccard similarity of
   the shingles, at least ``SIMILAR``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, id_order, lean, shuffle_partitions, slices, written
from .components import connected_components
from .suffix_repeats import _parts, _planes, _runs, _sliding_min, _unplaned

SHINGLE = 5
LEAST = 50  #: words of a passage
HASHES = 8
AGREE = 3
SIMILAR = 0.8
DRIFT = 20  #: words by which the distance of two windows of one passage may differ
#: Functions that name a subsequence together. A pair of similarity 0.8 agrees in all of one of the
#: threes with probability 0.89, an exact one in all.
JOINTS = (tuple(range(HASHES)), (0, 1, 2), (3, 4, 5), (6, 7, 0), (1, 4, 7))
OFTEN = 16
#: Bits of a sign, how many signs a name of three has, and in how many of them another representative agrees.
SIGN, SIGNS, SIGNS_AGREE = 6, 5, 2
FEW = 8  #: windows of a name that all meet, whatever their signs
CHUNK = 1 << 20
BATCH = 16 << 20  #: bytes of text whose windows are sorted together
_POS = np.uint64((1 << 24) - 1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_ODD = 0x9E3779B97F4A7C15
_HIT = np.dtype([("like", "<i8"), ("at", "<u4"), ("like_at", "<u4"), ("k", "u1")])
_TOLD = np.dtype([("id", "<i8"), ("hit", _HIT)])
_KIND = np.uint64(15)  # a function or one of JOINTS, in the lowest bits of a hash


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def tokens(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's begin (one more at the end).
    A-Z count as a-z; words are runs without ASCII white space."""
    x = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size  # of each text in x
    word = ~_WHITE[x]
    edge = np.diff(word.astype(np.int8))
    start, end = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
    # hash of x[a:b]: sum of bytes times powers, brought back to the first power
    power = np.full(len(x), _ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(x), pow(_ODD, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[x] + np.uint64(1)) * power, dtype=np.uint64)))
    w = _mixed((total[end] - total[start]) * back[start]) + (end - start).astype(np.uint64)
    first = np.searchsorted(start, np.append(begin, len(x)))  # first word of each text
    n = np.maximum(np.diff(first) - k + 1, 0)
    h = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for j in range(k):
        h = h * np.uint64(_ODD) + w[j:j + len(h)]
    at = np.concatenate(([0], np.cumsum(n)))
    keep = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)
    return _mixed(h[keep]), at


def _least(h: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under function ``salt``, and the place of the smallest in each run of ``least`` tokens."""
    v = _mixed(h, salt + 1)
    low = _sliding_min((v & ~_POS) | np.arange(len(h), dtype=np.uint64), least)
    return v, (low & _POS).astype(np.int64)


def _inside(at: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of ``n`` runs of ``least`` tokens lie in one text."""
    step = np.zeros(n + 1, np.int32)
    whole = np.diff(at) >= least
    np.add.at(step, at[:-1][whole], 1)
    np.add.at(step, at[1:][whole] - least + 1, -1)
    return np.cumsum(step[:n]) > 0


def centers(h: np.ndarray, at: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the Cartesian trees (one for each text) of the hashes under function ``salt`` whose
    range has ``least`` tokens: places in ``h``, and their hashes. Ties go to the left."""
    n = len(h) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v, low = _least(h, least, salt)
    place = np.unique(low[_inside(at, n, least)])
    return place, v[place]


def named_windows(h: np.ndarray, at: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and names of all texts' windows: the centers under each function, then for each of
    ``JOINTS`` the subsequences of ``least`` tokens by the min-hashes of its functions, once from where
    one of these changes. A name stands at the center of its first function, the same token in every
    text that has the subsequence."""
    return [(place, name) for place, name, _ in signed_windows(h, at, least)]


def signed_windows(h: np.ndarray, at: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``named_windows`` with signs: low bits of the min-hash under each function that a name of several
    leaves out (0 for the other windows)."""
    n = len(h) - least + 1
    if n <= 0:
        return []
    inside = _inside(at, n, least)
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) >= least]] = True
    out, lows, mins, moves = [], [], [], []
    for k in range(HASHES):
        v, low = _least(h, least, k)
        place = np.unique(low[inside])
        out.append((place, v[place], np.zeros(len(place), np.uint64)))
        lows.append(low)
        mins.append(v[low])
        moves.append(np.concatenate(([True], low[1:] != low[:-1])))
    for joint in JOINTS:
        begin = np.nonzero(inside & (first | np.logical_or.reduce([moves[k] for k in joint])))[0]
        name, signs = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
        for k in joint:
            name = name * np.uint64(_ODD) + mins[k][begin]
        for k in set(range(HASHES)) - set(joint):
            signs = (signs << np.uint64(SIGN)) | (mins[k][begin] & np.uint64((1 << SIGN) - 1))
        out.append((lows[joint[0]][begin], _mixed(name), signs))
    return out


def _stretches(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of h[lo:hi]: sums of tokens times powers, brought back to the first power."""
    power = np.full(len(h) + 1, _ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(h) + 1, pow(_ODD, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)))
    return (total[hi] - total[lo]) * back[lo]


def inner(h: np.ndarray, place: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Centers inside a periodic run: the same hash comes before and after, each within ``DRIFT`` tokens
    of the same document, and the tokens from one to the next are the same both times."""
    order = np.lexsort((place, v, doc))
    p = place[order]
    step = (np.diff(v[order]) == 0) & (np.diff(doc[order]) == 0) & (np.diff(p) <= DRIFT)
    name = _stretches(h, p[:-1], p[1:])
    out = np.zeros(len(place), bool)
    out[order[1:-1]] = step[:-1] & step[1:] & (np.diff(name) == 0) & (np.diff(p, 2) == 0)
    return out


def _chains(inside: np.ndarray) -> np.ndarray:
    """Where the periodic runs begin in windows sorted by hash and place (others are runs of one)."""
    begin = np.ones(len(inside), bool)
    begin[1:] = ~(inside[1:] | inside[:-1])
    return np.nonzero(begin)[0]


def compact_windows(place: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [l, r] of the centers of one text of ``n`` tokens, by a stack. The nearest smaller token
    on either side of a center is a center too, so no other token is looked at."""
    left, right = np.zeros(len(place), np.int64), np.full(len(place), n - 1, np.int64)
    stack: list[int] = []
    key = [(a & ~int(_POS), b) for a, b in zip(v.tolist(), place.tolist())]
    for i, p in enumerate(place.tolist()):
        while stack and key[stack[-1]] > key[i]:
            right[stack.pop()] = p - 1
        if stack:
            left[i] = place[stack[-1]] + 1
        stack.append(i)
    return left, right


def _near_ranges(place: np.ndarray, v: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Compact windows of the centers ``at`` (positions in ``place``), as far as ``least`` tokens
    around them; places further apart than that are those of other texts or functions."""
    small, out = v & ~_POS, []
    for way in (-1, 1):
        edge = place[at] + way * (least - 1)
        todo, other = np.arange(len(at)), at + way
        while len(todo):
            ok = (other >= 0) & (other < len(place))
            todo, other = todo[ok], other[ok]
            ok = np.abs(place[other] - place[at[todo]]) < least
            todo, other = todo[ok], other[ok]
            mine, theirs = small[at[todo]], small[other]
            stop = theirs <= mine if way < 0 else theirs < mine
            edge[todo[stop]] = place[other[stop]] - way
            todo, other = todo[~stop], other[~stop] + way
        out.append(edge)
    return out[0], out[1]


def _signed(h: np.ndarray) -> np.ndarray:
    """Which windows have signs."""
    return (h & _KIND) > HASHES


def _others(ids: np.ndarray, signs: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in groups (beginning at ``cut``) of one name, by id: pairs of a window and one of an
    earlier document, beside the first of the group, where signs differ in the group. In groups of up to
    ``FEW`` windows that is every earlier document, else the first that agrees in ``SIGNS_AGREE`` signs
    or more, for each choice of these signs."""
    size = np.diff(np.append(cut, len(ids)))
    mixed = np.minimum.reduceat(signs, cut) != np.maximum.reduceat(signs, cut) if len(cut) else np.zeros(0, bool)
    row = np.nonzero(np.repeat(mixed & (size > 2), size))[0]
    if not len(row):
        return row, row
    group, own, out = np.repeat(np.arange(len(cut)), size)[row], ids[row], []
    few = size[group] <= FEW
    for back in range(1, FEW):
        asks = np.nonzero(few[back:] & (group[back:] == group[:-back]))[0] + back
        out.append((asks, asks - back))
    many = np.nonzero(~few)[0]
    for n in range(SIGNS, SIGNS_AGREE - 1, -1):
        for some in combinations([((1 << SIGN) - 1) << (SIGN * f) for f in range(SIGNS)], n):
            key = (group[many].astype(np.uint64) << np.uint64(SIGN * SIGNS)) | (signs[row[many]] & np.uint64(sum(some)))
            order = np.argsort(key, kind="stable")
            begin = _runs(key[order])
            out.append((many[order], many[np.repeat(order[begin], np.diff(np.append(begin, len(order))))]))
    asks, like = (np.concatenate(x) for x in zip(*out))
    real = (own[like] != own[asks]) & (own[like] != ids[cut[group[asks]]])
    asks, like = np.divmod(np.unique(asks[real] * len(row) + like[real]), len(row))
    return row[asks], row[like]


def _packed_rows(least: int, buckets: int):
    kinds = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()),
                       ("places", pa.binary()), ("signs", pa.binary()), ("known", pa.binary())])

    def packed(texts):
        ids, docs, hashes, places, signs, first = texts.column("id").to_numpy(), [], [], [], [], 0
        for part in slices(texts, "text", CHUNK):
            h, at = tokens([t or b"" for t in part.column("text").to_pylist()])
            for kind, (place, v, sign) in enumerate(signed_windows(h, at, least)):
                doc = np.searchsorted(at, place, side="right") - 1
                docs.append(first + doc)
                # sixteen bits for the bucket; the kind in the lowest bits
                hashes.append((v & ~_KIND) | np.uint64(kind))
                places.append(place - at[doc])
                signs.append(sign.astype(np.uint32))
            first += part.num_rows
        if not docs:
            return []
        doc, h, place, sign = np.concatenate(docs), np.concatenate(hashes), np.concatenate(places), np.concatenate(signs)
        order = np.argsort(h, kind="stable")  # texts come by id, and their places in order
        many = _runs(h[order])
        many = np.repeat(np.diff(np.append(many, len(h))) >= OFTEN, np.diff(np.append(many, len(h))))
        some = order[many]
        order[many] = some[np.lexsort((sign[some], h[some]))]
        doc, h, place, sign = doc[order], h[order], place[order], sign[order]
        # the first document with the hash in this batch; with the signs, too, where these may part them
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (many[1:] & (sign[1:] != sign[:-1])))) if len(h) else np.zeros(0, bool)
        cut = np.nonzero(fresh)[0]
        size = np.diff(np.append(cut, len(h)))
        head = np.repeat(cut, size)
        often = np.repeat(size >= OFTEN, size)
        rows = []
        told = np.nonzero(often & (ids[doc] != ids[doc[head]]))[0]
        if len(told):
            hit, own = _hits(ids[doc[head[told]]], place[told], place[head[told]], h[told]), ids[doc[told]]
            rows += [(part, b"", b"", b"", b"", b"", known) for part, known in _told(own, hit, buckets)]
        ask = np.nonzero(~often | (np.arange(len(h)) == head))[0]
        bucket = ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
        ask = ask[np.argsort(bucket[ask] * len(ids) + doc[ask], kind="stable")]
        for p in np.split(ask, _runs(bucket[ask])[1:]):
            edge = _runs(doc[p])
            rows.append((int(bucket[p[0]]), ids[doc[p[edge]]].astype("<i8").tobytes(), np.diff(np.append(edge, len(p))).astype("<u4").tobytes(),
                         _planes(h[p]), _planes(place[p], 4), _planes(sign[p[_signed(h[p])]], 4), None))
        return rows

    def run(batches):
        for whole in batches:
            for texts in slices(whole, "text", BATCH):
                texts = texts.take(pa.array(np.argsort(texts.column("id").to_numpy(), kind="stable")))
                if rows := packed(texts):
                    yield pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)}, schema=kinds)

    return lean(run)


def _hits(like: np.ndarray, at: np.ndarray, like_at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places ``at`` with the first document of their hash."""
    out = np.zeros(len(like), _HIT)
    out["like"], out["at"], out["like_at"], out["k"] = like, at, like_at, (h & _KIND).astype(np.uint8)
    return out


def _told(own: np.ndarray, hit: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Hits of the documents ``own``, packed by part of all documents."""
    out = np.zeros(len(own), _TOLD)
    out["id"], out["hit"] = own, hit
    part = own % parts
    return [(int(part[p[0]]), out[p].tobytes()) for p in _parts(part, np.arange(len(part)))]


def _by_document(batches):
    """Packed hits by part -> (id, hits)."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for part, known in zip(b.column("part").to_pylist(), b.column("known").to_pylist()):
            held.setdefault(part, []).append(known)
    while held:
        told = np.frombuffer(b"".join(held.popitem()[1]), _TOLD)
        told = told[np.argsort(told["id"], kind="stable")]
        cut = _runs(told["id"])
        yield pa.RecordBatch.from_arrays([pa.array(told["id"][cut], pa.int64()),
                                          pa.array([p.tobytes() for p in np.split(told["hit"], cut[1:])], pa.binary())], ["id", "hits"])


def _answers(parts: int):
    def done(rows):
        ids = np.concatenate([np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4")) for i, c, _, _, _ in rows])
        h = np.concatenate([_unplaned(x) for _, _, x, _, _ in rows])
        place = np.concatenate([_unplaned(p, 4).astype(np.uint32) for _, _, _, p, _ in rows])
        sign = np.zeros(len(h), np.uint32)
        sign[_signed(h)] = np.concatenate([_unplaned(s, 4) for *_, s in rows])
        order = np.lexsort((place, ids, h))
        ids, h, place, sign = ids[order], h[order], place[order], sign[order]
        cut = _runs(h)
        head = np.repeat(cut, np.diff(np.append(cut, len(h))))
        told = np.nonzero(ids != ids[head])[0]
        asks, like = _others(ids, sign.astype(np.uint64), cut)
        told, like = np.concatenate((told, asks)), np.concatenate((head[told], like))
        hit, own = _hits(ids[like], place[told], place[like], h[told]), ids[told]
        return batch(_told(own, hit, parts))

    def batch(rows):
        cols = list(zip(*rows)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["part", "known"])

    def run(batches):
        held, bucket = [], None
        for b in batches:
            for k, i, c, h, p, s, known in zip(*[col.to_pylist() for col in b.columns]):
                if known is not None:
                    yield batch([(k, known)])
                    continue
                if k != bucket and held:
                    yield done(held)
                    held = []
                bucket = k
                held.append((i, c, h, p, s))
        if held:
            yield done(held)

    return lean(run)


def candidates(n: int, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], hits: np.ndarray, least: int,
               agree: int) -> list[tuple[int, int, int, int]]:
    """Interval join of one text of ``n`` tokens with its representatives: (like, first token, token
    after the last, distance to the counterpart). ``windows``: centers, hashes and ``inner`` under each
    function; ``least`` in tokens. A place of a periodic run stands for all of it. A name of several
    functions counts as enough of them, in every subsequence that holds its place."""
    if n < least:
        return []
    shift = hits["at"].astype(np.int64) - hits["like_at"].astype(np.int64)
    order = np.lexsort((shift, hits["like"]))
    hits, shift = hits[order], shift[order]
    apart = np.ones(len(hits), bool)
    apart[1:] = (hits["like"][1:] != hits["like"][:-1]) | (np.diff(shift) > DRIFT)
    begin = np.nonzero(apart)[0]
    size = np.diff(np.append(begin, len(hits)))
    if not len(size):
        return []
    joint = hits["k"] >= HASHES
    group = np.repeat(np.arange(len(size)), size)
    each = np.unique(group[~joint] * HASHES + hits["k"][~joint]) // HASHES
    many = np.bincount(each, minlength=len(size)) >= agree  # functions
    some = np.nonzero(many | np.logical_or.reduceat(joint, begin))[0]
    if not len(some):
        return []
    spot = hits["at"].astype(np.int64)
    lo, hi = np.where(joint, np.maximum(spot - least + 1, 0), 0), np.where(joint, np.minimum(spot, n - least), -1)
    mine = np.nonzero(many[group] & ~joint)[0]
    if len(mine):
        # the places of all functions in a row, too far apart to meet
        apart = (n + least) * np.arange(len(windows))
        place = np.concatenate([p + x for (p, _, _), x in zip(windows, apart)])
        v, inside = np.concatenate([v for _, v, _ in windows]), np.concatenate([x for _, _, x in windows])
        want = spot[mine] + apart[hits["k"][mine]]
        at = np.minimum(np.searchsorted(place, want), len(place) - 1)
        mine, at = mine[place[at] == want], at[place[at] == want]  # a hit may be one of another text with the same id
        base = apart[hits["k"][mine]]
        if inside.any():
            l, r = _near_ranges(place, v, np.arange(len(place)), least)
            order = np.lexsort((place, v))
            chain = _chains(inside[order])
            long = np.diff(np.append(chain, len(order)))
            # subsequences of ``least`` tokens in the window begin at l .. r
            r = np.minimum(place, r - least + 1)
            l[order] = np.repeat(np.minimum.reduceat(l[order], chain), long)
            r[order] = np.repeat(np.maximum.reduceat(r[order], chain), long)
            l, r = l[at], r[at]
        else:
            l, r = _near_ranges(place, v, at, least)
            r = np.minimum(place[at], r - least + 1)
        lo[mine], hi[mine] = np.maximum(l - base, 0), np.minimum(r - base, n - least)
    out = []
    for g in some.tolist():
        a = int(begin[g])
        p = slice(a, a + int(size[g]))
        pairs = np.unique(((hits["k"][p].astype(np.int64) << 50) | (lo[p] << 25) | (hi[p] + 1))[hi[p] >= lo[p]])
        pairs = np.stack((pairs >> 50, (pairs >> 25) & 0x1FFFFFF, pairs & 0x1FFFFFF), 1)
        # positions in which the windows of enough functions hold a subsequence
        edge = np.concatenate((pairs[:, 1], pairs[:, 2]))
        weight = np.where(pairs[:, 0] < HASHES, 1, agree)
        step = np.concatenate((weight, -weight))
        order = np.lexsort((-step, edge))
        edge, count = edge[order], np.cumsum(step[order])
        enough = np.diff(np.concatenate(([0], (count >= agree).astype(np.int8))))
        middle = int(np.median(shift[p]))
        out += [(int(hits["like"][a]), int(x), int(y) - 1 + least, middle)
                for x, y in zip(edge[enough == 1], edge[enough == -1]) if y > x]
    return out


def verified(own: np.ndarray, other: np.ndarray, least: int, similar: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of ``own`` (tokens) that are like one of ``other``: (first, after the last, first and
    after the last in ``other``, Jaccard similarity). A stretch that is not similar enough as a whole
    is parted at its longest gap of tokens that the other side lacks; one shorter than ``least`` reaches
    out over such tokens on either side up to that length."""
    order = np.argsort(other, kind="stable")
    place = np.searchsorted(other[order], own)
    place = np.minimum(place, len(other) - 1)
    same = other[order][place] == own if len(other) else np.zeros(len(own), bool)
    where = np.nonzero(same)[0]
    there = order[place[where]] if len(where) else where
    fresh = np.zeros(len(own), bool)
    fresh[np.unique(own, return_index=True)[1]] = True
    matched, lacked = (np.concatenate(([0], np.cumsum(x))) for x in (same, fresh & ~same))

    def compare(first, last, lo, hi):
        mine, theirs = np.unique(own[first:last]), np.unique(other[lo:hi])
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        return both / (len(mine) + len(theirs) - both)

    out, todo = [], [(0, len(where))]
    while todo:
        a, z = todo.pop()
        if z - a < 2:
            continue
        first, last = where[a], where[z - 1] + 1
        lo, hi = int(there[a:z].min()), int(there[a:z].max()) + 1
        if last - first < least:
            begin = np.arange(max(0, last - least), min(first, len(own) - least) + 1)
            most, lack = matched[begin + least] - matched[begin], lacked[begin + least] - lacked[begin]
            # the bound leaves out what can't be similar enough
            tries = [(int(x), int(x) + least, max(0, lo - int(first - x)), min(len(other), hi + int(x + least - last)))
                     for x in begin[most >= similar * (most + lack)]]
            best = max(((compare(*t), t) for t in tries), key=lambda t: t[0], default=(0, ()))
            if best[0] >= similar:
                out.append((*best[1], best[0]))
            continue
        share = compare(first, last, lo, hi)
        if share >= similar:
            out.append((int(first), int(last), lo, hi, share))
        else:
            gap = np.maximum(np.diff(where[a:z]), np.abs(np.diff(there[a:z])))
            cut = a + int(gap.argmax()) + 1
            todo += [(a, cut), (cut, z)]
    return sorted(set(out))


def passages(docs: DataFrame, least: int = LEAST, agree: int = AGREE, similar: float = SIMILAR) -> DataFrame:
    """Verified passages: doc_id, start_word, n_words, like_id, like_start, like_words, similarity.

    ``like_id`` is an earlier document (smaller doc_id) with a passage of at least ``least`` words
    whose five-word shingles have a Jaccard similarity of ``similar`` or more. NULL ids come last and
    are told as NULL; rows of one id are no near-duplicates of each other; repeated rows count once;
    NULL, empty and short texts and empty tables give nothing.
    """
    rows = docs.select(id_order().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    n, span = min(shuffle_partitions(docs), 1 << 16), least - SHINGLE + 1
    packed = rows.mapInArrow(_packed_rows(span, n), "bucket int, ids binary, counts binary, hashes binary, places binary, signs binary, known binary")
    told = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answers(n), "part int, known binary")
    hits = written(told.repartition(n, "part").mapInArrow(lean(_by_document), "id long, hits binary"), "hits")

    def joined(batches):
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                texts, ids, out = b.column("text").to_pylist(), b.column("id").to_pylist(), []
                h, at = tokens(texts)
                per_k = [centers(h, at, span, k) for k in range(HASHES)]
                inside = [inner(h, place, v, np.searchsorted(at, place, side="right") - 1) for place, v in per_k]
                cuts = [np.searchsorted(place, at) for place, _ in per_k]
                for d, got in enumerate(b.column("hits").to_pylist()):
                    n = int(at[d + 1] - at[d])
                    windows = [(place[c[d]:c[d + 1]] - at[d], v[c[d]:c[d + 1]], x[c[d]:c[d + 1]]) for (place, v), x, c in zip(per_k, inside, cuts)]
                    got = np.frombuffer(got, _HIT)
                    found = candidates(n, windows, got[got["at"] < n], span, agree)
                    words = texts[d].split() if found else []
                    for like, a, z, shift in found:
                        a, z = max(0, a - DRIFT), min(n, z + DRIFT)
                        out.append((ids[d], like, a, a - shift - 2 * DRIFT, z - shift + 2 * DRIFT, b" ".join(words[a:z + SHINGLE - 1])))
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.binary()])],
                                                 ["id", "like", "first", "lo", "hi", "words"])

    def compared(batches):
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                own, own_at = tokens(b.column("words").to_pylist())
                other, other_at = tokens(b.column("text").to_pylist())
                out = []
                for d, (i, like, first, lo, hi) in enumerate(zip(*[b.column(c).to_pylist() for c in ("id", "like", "first", "lo", "hi")])):
                    theirs = other[other_at[d]:other_at[d + 1]]
                    lo, hi = max(0, lo), max(0, hi)
                    for a, z, p, q, share in verified(own[own_at[d]:own_at[d + 1]], theirs[lo:hi], span, similar):
                        out.append((i, first + a, z - a + SHINGLE - 1, like, lo + p, q - p + SHINGLE - 1, share))
                cols = list(zip(*out)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 6 + [pa.float64()])],
                                                 ["id", "start_word", "n_words", "like", "like_start", "like_words", "similarity"])

    kinds = "id long, start_word long, n_words long, like long, like_start long, like_words long, similarity double"

    found = rows.join(hits, "id").mapInArrow(lean(joined), "id long, like long, first long, lo long, hi long, words binary")
    both = (found.join(rows.withColumnRenamed("id", "like"), "like").select("id", "like", "first", "lo", "hi", "words", "text")
            .mapInArrow(lean(compared), kinds))
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return both.distinct().select(real("id").alias("doc_id"), "start_word", "n_words", real("like").alias("like_id"), "like_start",
                                  "like_words", "similarity")


def passage_classes(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """``passages`` with ``class_id``: the smallest doc_id reachable over passages (documents without
    any are not listed)."""
    found = written(passages(docs, least, AGREE, similar), "passages")
    parts = connected_components(found.select(F.col("doc_id").alias("a"), F.col("like_id").alias("b")))
    out = found.join(parts, found.doc_id == parts.node, "left")
    return out.select(*found.columns, F.coalesce("root", "like_id", "doc_id").alias("class_id"))
