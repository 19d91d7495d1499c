"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merge list produces.
It starts with one arc for each base symbol out of every state; every merge (u, v) -> w, in order,
is one gadget: the state after ``u`` loses its arc ``v``, every state with an arc ``u`` gets an arc
``w``, and the state after ``w`` begins as a copy of the state after ``v``. States are named by the
token that leads to them, so the automaton is deterministic.

Rows of arcs are shared between a state and the copies made of it: a gadget notes only what it cut
and where its copy came from, and ``arc`` follows these notes back in time. Transitions that texts
ask for are kept in a table.

Every prefix of a word has one accepted token sequence. The encoder walks a tree of the tokens'
letters and follows the longest arc that spells the next symbols; where it ends up with no arc it
steps back to what it has not tried, and never comes to the same position again, so its work is
linear in the word. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_value
from .common import lean

#: Entries of the tables of a worker: transitions, runs without white space, and words in such runs.
TABLE = 100_000
RUNS, WORDS = 150_000, 50_000
#: Entries of a node of the token tree beside its letters.
INSIDE, AT_END = 0, 1
#: White space for Python's ``str.split`` but not for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else
    the next free one from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = iter(range(256))
    return [chr(b) if b in set(shown) else chr(256 + next(hidden)) for b in range(256)]


class Automaton:
    """Merges compiled gadget by gadget. ``vocab``: token -> id; ``merges``: pairs of tokens."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.table.clear()

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        # a pair that can no longer stand side by side changes nothing
        if w in self.born or (u, v) in self.cut or not self._had(u, v, rank):
            return
        self.left[w], self.right[w], self.born[w] = u, v, rank
        self.cut[u, v] = rank

    def _had(self, p: int, t: int, time: int) -> bool:
        """Whether the state after ``p`` has an arc ``t`` just before gadget ``time``."""
        while True:
            if self.cut.get((p, t), time) < time:
                return False
            p_born, t_born = self.born.get(p, -1), self.born.get(t, -1)
            if p_born < 0 and t_born < 0:
                return True
            if t_born > p_born:  # the arc came with t, if there was an arc for its left part after the cut
                t, time = self.left[t], t_born + 1
            elif p == t:  # the state came as a copy, and then got the arc of its own gadget
                p, t, time = self.right[p], self.left[t], p_born
            else:  # the state came as a copy of the one after its right part
                p, time = self.right[p], p_born

    def arc(self, p: int, t: int) -> bool:
        """Whether the finished automaton has an arc ``t`` out of the state after ``p``."""
        found = self.table.get((p, t))
        if found is None:
            if len(self.table) >= 2 * TABLE:
                self.table.clear()
            found = self.table[p, t] = self._had(p, t, 1 << 60)
        return found


class Recent(dict):
    """Answers of ``of``, kept in two generations: a full table becomes the old one, and what is
    asked for again moves over from it."""

    def __init__(self, of, size: int):
        super().__init__()
        self.of, self.size, self.old = of, size, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.of(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Tokenizer:
    """Encoder and decoder of a tokenizer file (JSON) with byte-level symbols, an end-of-word
    suffix, and words split off by a pattern after NFC, white space to one space, lower case."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        #: tree of the tokens' letters; a node has the id of the token it spells, inside a word or at its end
        self.tree: dict = {}
        self.longest = max(map(len, self.vocab))
        for t, i in self.vocab.items():
            node, last = self.tree, bool(self.end) and t.endswith(self.end)
            for c in t[:len(t) - len(self.end)] if last else t:
                node = node.setdefault(c, {})
            node[AT_END if last or not self.end else INSIDE] = i
            if not self.end:
                node[INSIDE] = i
        self.automaton = Automaton(self.vocab, merges)
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                      if self.special else r"(?!)()")
        self.symbols = byte_symbols()
        self.words, self.chunks = Recent(self._word, WORDS), Recent(self._chunk, RUNS)

    def _word(self, word: str) -> tuple[int, ...]:
        """Tokens of one word off the pattern."""
        if word.isascii() and word.isalnum():
            return self._path(word)
        return self._path("".join(map(self.symbols.__getitem__, word.encode("utf-8", "replace"))))

    def _path(self, s: str) -> tuple[int, ...]:
        n, longest, arc, known, tree = len(s), self.longest, self.automaton.arc, self.automaton.table.get, self.tree
        if (whole := self.vocab.get(s + self.end)) is not None:
            return (whole,)
        out: list[int] = []
        ends, left = [0], []  # positions on the path, and what else can be tried at those before the last
        closed: set[int] = set()  # positions from which the end can't be reached
        spelled = None  # tokens that spell the next letters, the longest last
        while (i := ends[-1]) < n:
            last = out[-1] if out else -1
            if spelled is None:
                spelled, node, j = [], tree, i
                for c in s[i:i + longest]:
                    node = node.get(c)
                    if node is None:
                        break
                    j += 1
                    if (t := node.get(INSIDE if j < n else AT_END)) is not None:
                        spelled.append((t, j))
            while spelled:
                t, j = spelled.pop()
                if j in closed:
                    continue
                ok = last < 0 or known((last, t))
                if ok or ok is None and arc(last, t):
                    out.append(t)
                    ends.append(j)
                    left.append(spelled)
                    spelled = None
                    break
            else:
                if not out:
                    raise ValueError(f"no token sequence for {s!r}")
                closed.add(i)
                out.pop()
                ends.pop()
                spelled = left.pop()
        return tuple(out)

    def _known(self, word: str) -> tuple[int, ...]:
        """A word inside a run; one of letters alone may have been a run of its own."""
        if word.isascii() and word.isalpha() and (got := self.chunks.get(word) or self.chunks.old.get(word)):
            return got
        return self.words[word]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a run without white space. Special tokens are found in the raw text."""
        if chunk.isascii() and "<" not in chunk:
            plain = chunk.lower()
            if plain.isalpha():
                return self._path(plain) if plain == chunk else self._known(plain)
            return tuple(chain.from_iterable(map(self._known, self.pattern.findall(plain))))
        out: list[int] = []
        for k, part in enumerate(self.specials.split(chunk)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                # lower case goes letter by letter: a capital sigma has one form
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for w in self.pattern.findall(plain):
                    out += self.words[w]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; NULL and empty texts have none."""
        if not text:
            return []
        if any(c in text for c in SEPARATORS):  # these are not white space here
            chunks = [c for c in regex.split(r"\s+", text, flags=regex.V1) if c]
        else:
            chunks = text.split()
        return list(chain.from_iterable(map(self.chunks.__getitem__, chunks)))

    def decode(self, ids: Iterable[int]) -> str:
        """Labels of the arcs taken, with a space between two (the file names no decoder)."""
        return " ".join(map(self.labels.__getitem__, ids))


_COMPILED: dict[str, Tokenizer] = {}


def compiled(spec: bytes) -> Tokenizer:
    """Compile once per Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Tokenizer(spec)
    return _COMPILED[key]


def _spec(spark, path: str):
    """The file, read by the driver (its size is that of one vocabulary) and sent to the workers."""
    with open(path, "rb") as f:
        return broadcast_value(spark, f.read())


def _mapped(docs: DataFrame, path: str, keep: list[str], columns: list[tuple[str, str, pa.DataType]], of) -> DataFrame:
    spec = _spec(docs.sparkSession, path)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*keep).schema
    for name, kind, _ in columns:
        schema = schema.add(name, kind)

    def run(batches):
        t = compiled(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # token lists of few rows at a time
                part = b.slice(at, 256)
                got = [of(t, x.as_py()) for x in part.column("__text")]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array([g[i] for g in got], k) for i, (_, _, k) in enumerate(columns))],
                    [*part.schema.names[:-1], *(c[0] for c in columns)])

    return rows.mapInArrow(lean(run), schema)


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``text``) of every row plus ``n_tokens`` and ``token_ids`` of its
    whole text. NULL and empty texts have no tokens; repeated rows stay; no rows give none."""
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")] if keep is None else keep
    from pyspark.sql.types import ArrayType, IntegerType, LongType

    def of(t, text):
        ids = t.encode(text)
        return len(ids), ids

    return _mapped(docs, path, keep, [("n_tokens", LongType(), pa.int64()), ("token_ids", ArrayType(IntegerType()), pa.list_(pa.int32()))], of)


def decoded(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``rows`` plus ``decoded``: the text that the arcs of ``ids`` spell; NULL ids give none."""
    spec = _spec(rows.sparkSession, path)

    @F.pandas_udf("string")
    def of(column):
        t = compiled(spec.value)
        return column.map(lambda x: "" if x is None else t.decode(x))

    return rows.withColumn("decoded", of(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by a space, and of what the ids
    decode to. One pass: the ids are encoded and decoded in the same task and never leave it."""
    from pyspark.sql.types import LongType, StringType

    def of(t, text):
        ids = t.encode(text)
        return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(t.decode(ids).encode()).hexdigest())

    return _mapped(docs, path, ["doc_id"], [("n_tokens", LongType(), pa.int64()), ("ids_sha256", StringType(), pa.string()),
                                           ("decoded_sha256", StringType(), pa.string())], of)
