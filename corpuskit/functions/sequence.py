"""Sequence ratio (twice the characters in matching blocks over both lengths) for many pairs at once.

The longest common run of a rectangle (part of one text against part of the other) is a matching block,
and the rectangles before and after it are searched in turn. All rectangles of a batch of pairs go
through one array program: a bit tells whether a run of k characters ends in a cell, 64 cells a machine
word, and only rows that still have a run go on to k + 1. Rectangles too large for that take the
run-length table, a row at a time.
Results equal Python's ``difflib.SequenceMatcher(None, a, b).ratio()``, in texts of 200 characters or
more with its rule for popular characters, too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Second texts of this length or more leave out characters that take over 1 % of them.
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Cells of a row of rectangles handled together; words of 64 cells handled by bits at a time, and at most.
CELLS, CELL_WORDS, MOST_WORDS = 1 << 18, 1 << 16, 1 << 20
#: Words of 64 characters times letters of the masks of the texts handled together.
MASKS = 1 << 20
#: Codes that stand for no character, counted back from the largest: the end of a row, a popular
#: character, and what lies outside a rectangle in a first and in a second text.
END, POPULAR, OUTSIDE_FIRST, OUTSIDE_SECOND, N_MARKS = range(5)


def _mark(kind: np.dtype, which: int) -> int:
    return np.iinfo(kind).max - which


class Texts:
    """Texts as rows of small codes, with the character counts that bound a ratio."""

    def __init__(self, texts: Sequence[str], alphabet: np.ndarray):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32) if len(alphabet) + N_MARKS <= np.iinfo(k).max)
        codes = np.searchsorted(alphabet, points).astype(kind)
        starts = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(texts)), self.size)
        self.codes = np.full((len(texts), max(1, int(self.size.max(initial=0)))), _mark(kind, END), kind)
        self.codes[row, np.arange(len(points)) - np.repeat(starts, self.size)] = codes
        self.counts = np.zeros((len(texts), max(1, len(alphabet))), np.int32)
        np.add.at(self.counts, (row, codes), 1)

    def seeds(self) -> np.ndarray:
        """Codes with popular characters taken out, for second texts."""
        most = self.size // POPULAR_SHARE + 1
        popular = (self.counts > most[:, None]) & (self.size >= POPULAR_FROM)[:, None]
        kind = self.codes.dtype
        known = np.minimum(self.codes, popular.shape[1] - 1).astype(np.int64)
        out = np.take_along_axis(popular, known, axis=1) | (self.codes == _mark(kind, END))
        return np.where(out, kind.type(_mark(kind, POPULAR)), self.codes)


def alphabet(*groups: Sequence[str]) -> np.ndarray:
    joined = "".join("".join(g) for g in groups)
    return np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))


def upper_bounds(a: Texts, b: Texts) -> np.ndarray:
    """Highest possible ratio of every pair, from the characters both have in any order."""
    both = np.zeros((len(a.size), len(b.size)), np.int64)
    for c in range(a.counts.shape[1]):
        both += np.minimum(a.counts[:, c, None], b.counts[None, :, c])
    total = a.size[:, None] + b.size[None, :]
    return np.where(total > 0, 2.0 * both / np.maximum(total, 1), 1.0)


def _cut(codes: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, fill: int) -> np.ndarray:
    at = low[None, :] + np.arange(width)[:, None]
    got = codes[rows[None, :], np.minimum(at, codes.shape[1] - 1)]
    return np.where(at < high[None, :], got, codes.dtype.type(_mark(codes.dtype, fill)))


def _longest(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first (rows, n), second (columns, n): per rectangle the length of the longest run, and where it
    starts; the earliest in the first text, then in the second."""
    n, longest = first.shape[1], min(len(first), len(second))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if longest <= np.iinfo(k).max)
    before, now = (np.zeros((len(second) + 1, n), kind) for _ in range(2))
    best, row, column = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    same = np.empty(second.shape, bool)
    for r in range(len(first)):
        np.equal(second, first[r][None, :], out=same)
        np.add(before[:-1], 1, out=now[1:])
        np.multiply(now[1:], same, out=now[1:])
        high = now.max(axis=0)
        more = np.flatnonzero(high > best)
        if len(more):
            column[more] = now[:, more].argmax(axis=0) - 1
            row[more], best[more] = r, high[more]
        before, now = now, before
    best = best.astype(np.int64)
    return best, np.where(best > 0, row - best + 1, 0), np.where(best > 0, column - best + 1, 0)


class Masks:
    """The second texts ``first`` up to ``last``, each from a word of its own: a row for each code, with
    a bit for each character that is the code. The last bit of a text is never set."""

    def __init__(self, seeds: np.ndarray, n_codes: int, words: np.ndarray, first: int, last: int):
        self.at = np.zeros(len(words), np.int64)
        ends = np.cumsum(words[first:last]) + 1  # the first column is empty
        self.at[first:last] = ends - words[first:last]
        self.table = np.zeros((n_codes, int(ends[-1]) + 1), np.uint64)  # and so is the last
        self.owner = np.concatenate([[first], np.repeat(np.arange(first, last), words[first:last]), [first]])
        row, col = np.nonzero(seeds[first:last] < n_codes)
        cell = seeds[first + row, col].astype(np.int64) * self.table.shape[1] + self.at[first + row] + col // 64
        np.bitwise_or.at(self.table.reshape(-1), cell, np.uint64(1) << (col % 64).astype(np.uint64))


def _low_bit(x: np.ndarray) -> np.ndarray:
    return np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1].astype(np.int64) - 1


def _longest_of_all(codes: np.ndarray, sizes: np.ndarray, masks: Masks, low: int, high: int, n: int):
    """First texts against the second texts in the columns ``low`` to ``high`` of the masks: as
    ``_longest``, a value for each of the ``n`` second texts a first text, 0 where no run has two
    characters. Bits of two characters in a row are found once for each such two."""
    one, n_codes = np.uint64(1), len(masks.table)
    line = np.repeat(np.arange(len(sizes)), sizes - 1)
    row = np.arange(len(line)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1) + 1
    twos, two = np.unique(codes[line, row - 1].astype(np.int64) * n_codes + codes[line, row], return_inverse=True)
    left = masks.table[:, low - 1:high].take(twos // n_codes, axis=0)
    runs = left << one
    runs[:, 1:] |= left[:, :-1] >> np.uint64(63)
    runs &= masks.table[:, low - 1:high].take(twos % n_codes, axis=0)
    runs[:, 0] = 0  # of the text before
    runs[:, 1] &= ~one
    of, column = np.nonzero(runs)
    bits, each = runs[of, column], np.bincount(of, minlength=len(twos))
    at, loads, lines = np.cumsum(each) - each, each[two], np.cumsum(sizes - 1)
    best, end_row, end = (np.zeros(len(sizes) * n, np.int64) for _ in range(3))
    total = np.cumsum(loads)[lines - 1] // CELL_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(sizes)]
    for x, y in zip(cuts, cuts[1:]):
        part = slice(int(lines[x] - sizes[x] + 1), int(lines[y - 1]))
        load = loads[part]
        place = np.repeat(np.arange(part.start, part.stop), load)
        pick = np.repeat(at[two[part]] - (np.cumsum(load) - load), load) + np.arange(len(place))
        col, values, k = column[pick], bits[pick], 2
        pair = line[place] * n + masks.owner[low - 1 + col]
        while len(place):
            back = slice(None, None, -1)  # the first cell is the last written
            best[pair] = k
            end_row[pair[back]], end[pair[back]] = row[place[back]], (low - 1 + col[back]) * 64 + _low_bit(values[back])
            # a run of one more: k characters that end here, and two that end k - 1 rows and columns before
            here = np.flatnonzero(row[place] >= k)
            place, col, values, pair = place[here], col[here], values[here], pair[here]
            step, word = np.uint64((k - 1) % 64), np.maximum(col - (k - 1) // 64, 0)
            from_ = two[place - (k - 1)]
            got = runs[from_, word] << step
            if step:
                got |= runs[from_, np.maximum(word - 1, 0)] >> (np.uint64(64) - step)
            values &= got
            keep = np.flatnonzero(values)
            place, col, values, pair, k = place[keep], col[keep], values[keep], pair[keep], k + 1
    best, end_row, end = (v.reshape(len(sizes), n) for v in (best, end_row, end))
    return best, end_row - best + 1, end - masks.at * 64 - best + 1


def _longest_by_bits(codes, ai, alo, ahi, masks: np.ndarray, mask_at, blo, bhi, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_longest``, for rectangles whose columns take ``words`` machine words."""
    n, one = len(alo), np.uint64(1)
    size = ahi - alo + 1  # a row without a match stands between two rectangles
    starts = np.cumsum(size) - size
    rect = np.repeat(np.arange(n), size)
    at = np.repeat(ai * codes.shape[1] + alo - 1 - starts, size)
    at += np.arange(len(rect))
    at[starts] = 0
    at = codes.reshape(-1).take(at).astype(np.int64)
    at[starts] = 0
    at *= masks.shape[1]
    at += np.repeat(mask_at + blo // 64, size)
    shift = (blo % 64).astype(np.uint64)
    moved = bool(shift.any())
    if moved:
        right, left = np.repeat(shift, size), np.repeat(np.uint64(63) - shift, size)
    flat = masks.reshape(-1)
    now = np.empty((words, len(rect)), np.uint64)
    for w in range(words):
        now[w] = flat.take(at)
        if moved:
            at += 1
            now[w] >>= right
            got = flat.take(at)
            got <<= one
            got <<= left
            now[w] |= got
        else:
            at += 1
    width = bhi - blo - 64 * (words - 1)  # bits of the last word, 1 to 64
    now[-1] &= np.repeat(~np.uint64(0) >> (64 - width).astype(np.uint64), size)
    now[:, starts] = 0
    best, row, bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((words, n), np.uint64)
    live = np.flatnonzero(now.any(axis=0) if words > 1 else now[0])
    where, k = live, 0
    while len(live):
        k += 1
        now = now[:, where]
        mine = rect[live]
        lead = np.append(0, np.flatnonzero(mine[1:] != mine[:-1]) + 1)
        best[mine[lead]], row[mine[lead]], bits[:, mine[lead]] = k, live[lead], now[:, lead]
        # runs of one more: such a run ends here, and one of k a row and a column before
        after = np.flatnonzero(live[1:] == live[:-1] + 1)
        behind = now[:, after]
        now = now[:, after + 1]
        now[1:] &= (behind[1:] << one) | (behind[:-1] >> np.uint64(63))
        now[0] &= behind[0] << one
        where = np.flatnonzero(now.any(axis=0) if words > 1 else now[0])
        live = live[after[where] + 1]
    word = (bits != 0).argmax(axis=0)
    column = word * 64 + _low_bit(bits[word, np.arange(n)])
    some = best > 0
    return best, np.where(some, row - starts - best, 0), np.where(some, column - best + 1, 0)


class Matching:
    """Matching blocks of the pairs (a[i], b[j]), whose first blocks are found at once: ``found``
    characters so far, and at most ``most`` in the end."""

    def __init__(self, a: Texts, b: Texts, i: np.ndarray, j: np.ndarray):
        self.a, self.b, self.i, self.j = a, b, i, j
        self.found = np.zeros(len(i), np.int64)
        self.seeds, n_codes = b.seeds(), b.counts.shape[1]
        words = b.size // 64 + 1
        # texts whose masks together are of bounded size; one that is too large alone has none
        filled, cuts = 0, [0]
        for t, size in enumerate((words * n_codes).tolist()):
            if t > cuts[-1] and filled + size > MASKS:
                cuts.append(t)
                filled = 0
            filled += size
        self.masks = [Masks(self.seeds, n_codes, words, x, y) if words[x] * n_codes <= MASKS else None for x, y in zip(cuts, [*cuts[1:], len(words)])]
        self.of = np.searchsorted(cuts, np.arange(len(words)), side="right") - 1
        self.rects = self._first(words, cuts)
        self.most = self._most()

    def _first(self, words: np.ndarray, cuts: list[int]) -> np.ndarray:
        """The rectangles beside the first blocks."""
        a, b, i, j = self.a, self.b, self.i, self.j
        size, x, y = (np.zeros(len(i), np.int64) for _ in range(3))
        for masks, first, last in zip(self.masks, cuts, [*cuts[1:], len(words)]):
            if masks is None:
                continue
            mine = np.flatnonzero((j >= first) & (j < last) & (a.size[i] > 1) & (a.size[i] * words[j] <= MOST_WORDS))
            texts, line = np.unique(i[mine], return_inverse=True)
            if not len(mine) or 4 * len(mine) < len(texts) * (last - first):
                continue  # few of many: rectangle by rectangle
            # texts of bounded size together, against columns of bounded size
            groups = np.cumsum(a.size[texts]) // (MOST_WORDS // 64)
            for t in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(groups)) + 1):
                room = max(1, 2 * MOST_WORDS // int(a.size[texts[t]].sum()))
                of_text = np.cumsum(words[first:last]) // room
                for e in np.split(np.arange(first, last), np.flatnonzero(np.diff(of_text)) + 1):
                    some = np.flatnonzero((line >= t[0]) & (line <= t[-1]) & (j[mine] >= e[0]) & (j[mine] <= e[-1]))
                    if not len(some):
                        continue
                    q = texts[t]
                    got = _longest_of_all(a.codes[q], a.size[q], masks, int(masks.at[e[0]]), int(masks.at[e[-1]] + words[e[-1]]), len(words))
                    size[mine[some]], x[mine[some]], y[mine[some]] = (v[line[some] - t[0], j[mine[some]]] for v in got)
        known = size > 0
        pair = np.flatnonzero((a.size[i] > 0) & (b.size[j] > 0))
        zero = np.zeros(len(pair), np.int64)
        rects = np.stack([pair, zero, a.size[i[pair]], zero, b.size[j[pair]]])
        done, todo = rects[:, known[pair]], rects[:, ~known[pair]]
        beside = self._beside(done, (size[done[0]], x[done[0]], y[done[0]]))
        return np.concatenate([beside, self._step(todo)], axis=1)

    def _most(self) -> np.ndarray:
        pair, alo, ahi, blo, bhi = self.rects
        return self.found + np.bincount(pair, np.minimum(ahi - alo, bhi - blo), len(self.i)).astype(np.int64)

    def finish(self, pairs: np.ndarray, need: np.ndarray | None = None) -> None:
        """Find all blocks of ``pairs`` (numbers); those that can't reach ``need`` characters (a value for
        every pair) are given up, which ``most`` then shows."""
        mine = np.zeros(len(self.i), bool)
        mine[pairs] = True
        rest = self.rects[:, ~mine[self.rects[0]]]
        self.rects = self.rects[:, mine[self.rects[0]]]
        while self.rects.shape[1]:
            if need is not None:
                most = self._most()
                out = mine & (most < need)
                self.most[out], mine = most[out], mine & ~out
                self.rects = self.rects[:, mine[self.rects[0]]]
            self.rects = self._step(self.rects)
        self.most[mine] = self.found[mine]
        self.rects = rest

    def _step(self, rects: np.ndarray) -> np.ndarray:
        """Add the longest block of every rectangle; the rectangles beside these."""
        beside = [np.zeros((5, 0), np.int64)]
        masked = self.of[self.j[rects[0]]]
        for m, masks in enumerate(self.masks):
            part = rects[:, masked == m]
            n_words = -(-(part[4] - part[3]) // 64)
            load = (part[2] - part[1] + 1) * n_words
            by_bits = np.full(len(load), masks is not None) & (load <= MOST_WORDS)
            # tables: rectangles of about one size together, so that little of a table is empty
            shape = np.where(by_bits, -n_words, np.frexp(part[4] - part[3])[1] * 64 + np.frexp(part[2] - part[1])[1])
            order = np.argsort(shape, kind="stable")
            part, shape, load = part[:, order], shape[order], load[order]
            ends = np.append(np.flatnonzero(np.diff(shape)) + 1, len(shape)) if len(shape) else []
            start = 0
            for end in ends:
                if shape[start] < 0:
                    total = np.cumsum(load[start:end]) // CELL_WORDS
                    cuts = [start, *(np.flatnonzero(np.diff(total)) + 1 + start).tolist(), end]
                else:
                    cuts = [*range(start, end, max(1, CELLS // int((part[4, start:end] - part[3, start:end]).max()))), end]
                for low, high in zip(cuts, cuts[1:]):
                    some = part[:, low:high]
                    beside.append(self._beside(some, self._by_bits(some, masks, -int(shape[start])) if shape[start] < 0 else self._by_table(some)))
                start = end
        return np.concatenate(beside, axis=1)

    def _by_bits(self, rects: np.ndarray, masks: Masks, n_words: int):
        pair, alo, ahi, blo, bhi = rects
        return _longest_by_bits(self.a.codes, self.i[pair], alo, ahi, masks.table, masks.at[self.j[pair]], blo, bhi, n_words)

    def _by_table(self, rects: np.ndarray):
        pair, alo, ahi, blo, bhi = rects
        first = _cut(self.a.codes, self.i[pair], alo, ahi, int((ahi - alo).max()), OUTSIDE_FIRST)
        return _longest(first, _cut(self.seeds, self.j[pair], blo, bhi, int((bhi - blo).max()), OUTSIDE_SECOND))

    def _beside(self, rects: np.ndarray, longest) -> np.ndarray:
        """Add each rectangle's longest run, as a block; the rectangles on both sides of it."""
        a, b = self.a, self.b
        pair, alo, ahi, blo, bhi = rects
        ai, bj = self.i[pair], self.j[pair]
        size, x, y = longest
        x, y = alo + x, blo + y
        if (b.size[bj] >= POPULAR_FROM).any():  # popular characters next to a block belong to it
            while True:
                go = np.flatnonzero((x > alo) & (y > blo))
                go = go[a.codes[ai[go], x[go] - 1] == b.codes[bj[go], y[go] - 1]]
                if not len(go):
                    break
                x[go], y[go], size[go] = x[go] - 1, y[go] - 1, size[go] + 1
            while True:
                go = np.flatnonzero((x + size < ahi) & (y + size < bhi))
                go = go[a.codes[ai[go], x[go] + size[go]] == b.codes[bj[go], y[go] + size[go]]]
                if not len(go):
                    break
                size[go] += 1
        np.add.at(self.found, pair, size)
        left = (size > 0) & (alo < x) & (blo < y)
        right = (size > 0) & (x + size < ahi) & (y + size < bhi)
        return np.concatenate([np.stack([pair, alo, x, blo, y])[:, left], np.stack([pair, x + size, ahi, y + size, bhi])[:, right]], axis=1)


def matched(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of the pairs (a[i], b[j])."""
    m = Matching(a, b, i, j)
    m.finish(np.arange(len(i)))
    return m.found


def ratios(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sequence ratio of the pairs (a[i], b[j]); two empty texts have 1."""
    total = a.size[i] + b.size[j]
    return np.where(total > 0, 2.0 * matched(a, b, i, j) / np.maximum(total, 1), 1.0)


# ------------------------------------------------------------------ edit distance


def _points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, where each begins, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum(size) - size, size


def edit_distances(first: Sequence[str], second: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Levenshtein distance of the pairs (first[i], second[j]): 64 rows of the table in one machine word
    (differences of neighbouring cells as bits), a column at a time for many pairs together."""
    a, a_at, a_size = _points(first)
    b, b_at, b_size = _points(second)
    letters = np.unique(a)
    n_codes = len(letters) + 1  # the last for what no first text has
    a = np.searchsorted(letters, a)
    at = np.minimum(np.searchsorted(letters, b), max(len(letters) - 1, 0))
    b = np.where(letters[at] == b, at, len(letters)) if len(letters) else np.zeros(len(b), np.int64)
    m, n = a_size[i], b_size[j]
    out = np.maximum(m, n)  # where one is empty
    words = -(-m // 64)
    todo = np.nonzero((m > 0) & (n > 0))[0]
    todo = todo[np.lexsort((i[todo], words[todo]))]
    for same in np.split(todo, np.nonzero(np.diff(words[todo]))[0] + 1):
        if not len(same):
            continue
        w = int(words[same[0]])
        step = max(1, MASKS // (w * n_codes))
        for k in range(0, len(same), step):
            part = same[k:k + step]
            part = part[np.argsort(-n[part], kind="stable")]
            out[part] = _distances(a, a_at, a_size, b, b_at[j[part]], n[part], i[part], w, n_codes)
    return out


def _distances(a, a_at, a_size, b, b_at, n, i, words: int, n_codes: int) -> np.ndarray:
    """Distances of pairs whose first texts have ``words`` words, from the longest second text on."""
    own, mine = np.unique(i, return_inverse=True)
    size = a_size[own]
    row, col = np.repeat(np.arange(len(own)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    masks = np.zeros(len(own) * n_codes * words, np.uint64)
    np.bitwise_or.at(masks, (row * n_codes + a[a_at[own][row] + col]) * words + col // 64, np.uint64(1) << (col % 64).astype(np.uint64))
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((words, len(i)), ~np.uint64(0)), np.zeros((words, len(i)), np.uint64)
    last, score, base = ((a_size[i] - 1) % 64).astype(np.uint64), a_size[i].copy(), mine * n_codes
    live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # pairs whose second text goes on
    for c, p in enumerate(live.tolist()):
        at = (base[:p] + b[b_at[:p] + c]) * words
        up_in, down_in = np.full(p, one), np.zeros(p, np.uint64)  # the first row grows by one a column
        for w in range(words):
            eq, pv, mv = masks[at + w], up[w, :p], down[w, :p]
            xv = eq | mv
            eq |= down_in
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if w == words - 1:
                score[:p] += ((ph >> last[:p]) & one).astype(np.int64) - ((mh >> last[:p]) & one).astype(np.int64)
            ph_in, mh_in = up_in, down_in
            up_in, down_in = ph >> top, mh >> top
            ph, mh = (ph << one) | ph_in, (mh << one) | mh_in
            up[w, :p], down[w, :p] = mh | ~(xv | ph), ph & xv
    return score
