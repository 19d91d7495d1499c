"""Byte-level BPE by replaying the merges over a corpus.

The distinct words of a block of texts are laid end to end as one row of symbols. An inverted index
holds, for each merge, the positions where its two symbols stand side by side. Merges are taken in rank
order over the whole block: all positions of the merge become one symbol, and only the pairs with the
touched neighbours are looked up again and entered into the index. Spark deals the corpus out in blocks
(Arrow batches cut to ``BLOCK`` bytes), and words do not depend on each other, so the cut changes nothing.

A merge is named by the token it makes, as the file gives ranks to tokens: any two tokens whose bytes
together are a token may merge, the lowest rank first, and of equal ranks the leftmost.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from ..session import broadcast_value
from .common import lean, slices

#: Bytes of text in a block. One longer text is a block of its own.
BLOCK = 8 << 20
#: Bytes of distinct words that are replayed together. One longer word is replayed alone.
REPLAY = 1 << 19
#: Words with their tokens that a worker remembers from earlier blocks.
KNOWN = 200_000
#: Longest word that is remembered, in characters.
LONGEST = 64


class Replay:
    """Encoder and decoder of a rank file (base64 token and rank a line) and a word pattern."""

    def __init__(self, spec: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines()) if a}
        self.labels = {r: t for t, r in self.ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing[:5]}")
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: two tokens, as one number -> the token they make
        self.step = max(self.labels) + 1
        self.merges = {a * self.step + b: r for t, r in self.ranks.items() for a, b in self._halves(t)}
        #: a merge after which one of a lower rank can come up next to it
        self.early = {p for t, r in self.ranks.items() for k in self._halves(t) for p in k if p > r and len(self.labels[p]) > 1}
        first = np.full((256, 256), -1, np.int64)
        for x in range(256):
            for y in range(256):
                first[x, y] = self.ranks.get(bytes([x, y]), -1)
        self.first = first
        self.split = regex.compile(pattern).findall
        # the same pattern on ASCII letters alone, for the faster engine
        plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
        self.plain = re.compile(plain, re.ASCII).findall if r"\p" not in plain else self.split
        self.known: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: bytes) -> list[tuple[int, int]]:
        at = [(self.ranks.get(token[:k]), self.ranks.get(token[k:])) for k in range(1, len(token))]
        return [(a, b) for a, b in at if a is not None and b is not None]

    # -------------------------------------------------------------- replay

    def replayed(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each word: all merges over all words, in rank order."""
        raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8)  # a gap after each word
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        gaps = np.cumsum(lengths + 1) - 1
        symbols = self.bytes[raw]
        symbols[gaps] = -1
        merge = np.full(len(raw), -1, np.int64)
        merge[:-1] = self.first[raw[:-1], raw[1:]]
        merge[gaps] = -1
        merge[gaps[lengths > 0] - 1] = -1

        # the index: merge -> positions, ascending
        at = np.flatnonzero(merge >= 0)
        order = at[np.argsort(merge[at], kind="stable")]
        found, starts = np.unique(merge[order], return_index=True)
        index = {r: part.tolist() for r, part in zip(found.tolist(), np.split(order, starts[1:]))}
        queue = list(index)
        heapify(queue)
        symbol, of = symbols.tolist(), merge.tolist()
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        merges, step, early = self.merges.get, self.step, self.early
        starts = (gaps - lengths).tolist()
        word_of = np.searchsorted(gaps, np.arange(len(raw))).tolist() if early else None
        while queue:
            rank = heappop(queue)
            positions = index.pop(rank)
            positions.sort()
            once, again, last = rank in early, [], -1
            for p in positions:
                if of[p] != rank:
                    continue
                if once:  # a lower merge may come up in this word: look again after it
                    if word_of[p] == last:
                        again.append(p)
                        continue
                    last = word_of[p]
                q = after[p]
                n = after[q]
                symbol[p], symbol[q] = rank, -2
                of[q] = -1
                after[p] = n
                before[n if n < len(symbol) else -1] = p
                right = symbol[n]
                new = of[p] = -1 if right < 0 else merges(rank * step + right, -1)
                if new >= 0:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heappush(queue, new)
                b = before[p]
                if b >= 0 and symbol[b] >= 0:
                    new = of[b] = merges(symbol[b] * step + rank, -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(b)
                        else:
                            index[new] = [b]
                            heappush(queue, new)
            if again:
                if rank in index:
                    index[rank] += again
                else:
                    index[rank] = again
                    heappush(queue, rank)
        out = []
        for a, z in zip(starts, gaps.tolist()):
            out.append(tuple([s for s in symbol[a:z] if s >= 0]))
        return out

    def _learn(self, words: Iterable[str], into: dict[str, tuple[int, ...]]) -> None:
        """Tokens of distinct words: those that are tokens themselves, the others by replay."""
        group, raw, held = [], [], 0

        def flush():
            into.update(zip(group, self.replayed(raw)))
            group.clear()
            raw.clear()

        for w in words:
            b = w.encode("utf-8", "replace")
            whole = self.ranks.get(b)
            if whole is not None:
                into[w] = (whole,)
                continue
            if held + len(b) > REPLAY and group:
                flush()
                held = 0
            group.append(w)
            raw.append(b)
            held += len(b)
        if group:
            flush()

    def block(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text of a block; NULL and empty texts have none."""
        cut = [[] if not t else (self.plain if t.isascii() else self.split)(t) for t in texts]
        distinct: set[str] = set()
        for words in cut:
            distinct.update(words)
        known = self.known
        here = {w: known[w] for w in distinct if w in known}
        self._learn(distinct - here.keys(), here)
        out = [list(chain.from_iterable(map(here.__getitem__, words))) for words in cut]
        if len(known) > KNOWN:
            known.clear()
        known.update((w, ids) for w, ids in here.items() if len(w) <= LONGEST)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids))


_COMPILED: dict[tuple[str, str], Replay] = {}


def compiled(spec: bytes, pattern: str) -> Replay:
    """Read once per Python worker."""
    key = hashlib.sha256(spec).hexdigest(), pattern
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Replay(spec, pattern)
    return _COMPILED[key]


def _spec(spark, path: str):
    """The file, read by the driver (its size is that of one vocabulary) and sent to the workers."""
    with open(path, "rb") as f:
        return broadcast_value(spark, f.read())


def _mapped(docs: DataFrame, path: str, pattern: str, keep: list[str], columns: list[tuple], of) -> DataFrame:
    spec = _spec(docs.sparkSession, path)
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], F.col("text").cast("string").alias("__text"))
    schema = docs.select(*[docs[f"`{c}`"] for c in keep]).schema
    for name, kind, _ in columns:
        schema = schema.add(name, kind)

    def run(batches):
        replay = compiled(spec.value, pattern)
        for batch in batches:
            for part in slices(batch, "__text", BLOCK):
                got = [of(replay, ids) for ids in replay.block(part.column("__text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array([g[i] for g in got], k) for i, (_, _, k) in enumerate(columns))],
                    [*part.schema.names[:-1], *(c[0] for c in columns)])

    return rows.mapInArrow(lean(run), schema)


def encoded(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``text``) of every row plus ``n_tokens`` and ``token_ids`` of its whole
    text. NULL and empty texts have no tokens; repeated rows stay; no rows give none; columns of the
    two new names are replaced. Special tokens in a text are ordinary text."""
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")] if keep is None else keep
    return _mapped(docs, path, pattern, keep,
                   [("n_tokens", LongType(), pa.int64()), ("token_ids", ArrayType(IntegerType()), pa.list_(pa.int32()))],
                   lambda replay, ids: (len(ids), ids))


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``rows`` plus ``decoded`` (binary): the bytes that ``ids`` spell; NULL ids give none."""
    spec = _spec(rows.sparkSession, path)

    @F.pandas_udf("binary")
    def of(column):
        replay = compiled(spec.value, pattern)
        return column.map(lambda x: b"" if x is None else replay.decode(x))

    return rows.withColumn("decoded", of(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by a space, and of the bytes the ids
    decode to. Encoded and decoded in one task, so ids never leave it. NULL and empty texts have no
    tokens and the digests of nothing; NULL ids and repeated rows stay; no rows give none."""
    def of(replay, ids):
        return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(replay.decode(ids)).hexdigest())

    return _mapped(docs, path, pattern, ["doc_id"], [("n_tokens", LongType(), pa.int64()), ("ids_sha256", StringType(), pa.string()),
                                                    ("decoded_sha256", StringType(), pa.string())], of)
