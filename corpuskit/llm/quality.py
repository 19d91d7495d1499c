"""Quality rules by weak supervision.

Every rule looks at counts of a document's whole text and votes good, bad, or abstains. The votes
of all documents are counted by pattern (at most 3^rules patterns, whatever the corpus size), and
expectation-maximisation over the patterns estimates how often each rule is right about good and
about bad documents, and the share of good ones. A document stays if its posterior probability of
being good reaches the threshold; no single rule has to pass.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, lean, written

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
BAD, ABSTAIN, GOOD = 0, 1, 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_top_word", "n_ends", "n_shouts")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS of one text; NULL counts as empty.

    Words are runs without ASCII white space. ``n_dup_lines``: lines with a word that equal an
    earlier line; ``n_repeat_words``: words in three-word windows that stand twice or more in the
    text, first ones included; ``n_top_word``: occurrences of the most frequent word;
    ``n_ends``: lines with a word that end a sentence; ``n_shouts``: exclamation marks.
    """
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        reach = 0  # words before this position are counted already
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    top = max(Counter(words).values()) if n else 0
    ends = sum(x.rstrip().endswith((b".", b"!", b"?", b":", b";")) for x in lines)
    return (n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, top, ends,
            data.count(b"!"))


_COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def counts(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the counts of every row's whole ``text``."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        for b in batches:
            got = np.array([text_counts(t.as_py()) for t in b.column("_text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in got.T)],
                                             [*b.schema.names[:-1], *COUNTS])

    return rows.mapInArrow(lean(run), schema)


# ------------------------------------------------------------------ rules

@dataclass(frozen=True)
class Rule:
    """Votes bad where ``share`` is at least ``bad``, good where it is at most ``good``, else
    abstains; with ``bad`` below ``good`` the other way round. NULL shares (no words) abstain."""
    name: str
    top: str
    of: str
    good: float
    bad: float

    def vote(self) -> Column:
        share = F.try_divide(F.col(self.top), F.col(self.of))
        if self.bad > self.good:
            bad, good = share >= self.bad, share <= self.good
        else:
            bad, good = share <= self.bad, share >= self.good
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.10),
    Rule("symbol_characters", "n_symbols", "word_chars", 0.004, 0.02),
    Rule("capitals", "n_upper", "n_letters", 0.12, 0.40),
    Rule("shouting", "n_shouts", "n_words", 0.05, 0.20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.10, 0.50),
    Rule("repeats", "n_repeat_words", "n_words", 0.10, 0.30),
    Rule("one_word", "n_top_word", "n_words", 0.15, 0.35),
    Rule("sentences", "n_ends", "n_lines", 0.80, 0.30),
)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """All votes of a row as one number in base three."""
    return sum((r.vote() * 3 ** i for i, r in enumerate(rules)), F.lit(0)).cast("int")


def votes_of(code: int, n: int) -> list[int]:
    return [code // 3 ** i % 3 for i in range(n)]


# ------------------------------------------------------------------ label model

#: First guess of how a rule votes (bad, abstain, good) about bad and about good documents.
GUESS = ((0.30, 0.20, 0.50), (0.01, 0.09, 0.90))


@dataclass(frozen=True)
class LabelModel:
    prior: float  #: share of good documents
    votes: tuple[tuple[tuple[float, ...], ...], ...]  #: by rule, class (bad, good) and vote: probability

    def accuracy(self) -> list[float]:
        """Per rule: how often a vote that is not an abstention is right."""
        out = []
        for (bad, good) in self.votes:
            right = (1 - self.prior) * bad[BAD] + self.prior * good[GOOD]
            wrong = (1 - self.prior) * bad[GOOD] + self.prior * good[BAD]
            out.append(right / (right + wrong))
        return out


def fit(counted: dict[int, int], n_rules: int, rounds: int = 200, weight: float = 50.0,
        guess: tuple = GUESS, good_share: float = 0.85) -> LabelModel:
    """Expectation-maximisation over vote patterns (pattern -> documents).

    The guesses also act as ``weight`` earlier documents of each class, so few or one-sided votes
    leave the model near them and the classes cannot change places. No patterns give the guesses.
    """
    codes = sorted(counted)
    n = np.array([counted[c] for c in codes], float)
    votes = np.array([votes_of(c, n_rules) for c in codes], np.int64).reshape(-1, n_rules)
    start = np.tile(np.array(guess)[None], (n_rules, 1, 1))
    theta, prior = start.copy(), good_share
    for _ in range(rounds if len(codes) else 0):
        each = np.log(theta[np.arange(n_rules)[None, :, None], np.arange(2)[None, None, :], votes[:, :, None]]).sum(1)
        odds = each[:, 1] - each[:, 0] + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        before = (prior, theta)
        prior = float(((n * p).sum() + good_share * weight) / (n.sum() + weight))
        theta = np.stack([[[(n * q)[votes[:, i] == v].sum() + start[i, c, v] * weight for v in range(3)]
                           for c, q in enumerate((1 - p, p))] for i in range(n_rules)])
        theta /= theta.sum(2, keepdims=True)
        if abs(prior - before[0]) < 1e-10 and np.abs(theta - before[1]).max() < 1e-10:
            break
    # rounded, so that sums in another order decide alike
    return LabelModel(round(prior, 9), tuple(tuple(tuple(max(1e-9, round(float(x), 9)) for x in c) for c in r) for r in theta))


def label_model(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """Fit on all rows of ``counts``; only the pattern table comes to the driver (at most 3^rules
    rows)."""
    found = counted.groupBy(pattern(rules).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit({r["p"]: r["n"] for r in found}, len(rules))


def quality(model: LabelModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """Posterior probability that a counted row is good."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for rule, (bad, good) in zip(rules, model.votes):
        says = [float(np.log(good[v] / bad[v])) for v in (BAD, ABSTAIN, GOOD)]
        odds = odds + F.element_at(F.array(*map(F.lit, says)), rule.vote() + 1)
    return F.round(1 / (1 + F.exp(-odds)), 9)


def scored(docs: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, quality (posterior) and kept.

    NULL and empty texts count zero words and fail the base rule; repeated rows each get their
    result; an empty table gives none. The counts are written once, as the fit and the result
    both read them.
    """
    counted = written(counts(docs), "counts")
    model = label_model(counted, rules)
    return (counted.withColumn("base_failed", base_failed()).withColumn("quality", quality(model, rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def good_documents(docs: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that are kept, all columns as they were. The texts are read twice and
    never shuffled."""
    model = label_model(counts(docs, ()), rules)

    @F.pandas_udf(_COUNT_SCHEMA)
    def of(text):
        import pandas as pd
        return pd.DataFrame([text_counts(t) for t in text], columns=list(COUNTS), dtype="int64")

    named = docs.select(boxed(docs).alias("whole"), of(F.col("text").cast("string")).alias("counts")).select("whole", "counts.*")
    return named.filter(~base_failed() & (quality(model, rules) >= threshold)).select("whole.*")
