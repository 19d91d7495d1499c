"""Column-expression building blocks for text. All JVM-side (codegen), no Python UDFs.

Python's ``\\w``/``\\s`` are Unicode-aware; Java's are not unless ``(?U)`` is set, so every
pattern that must match accented letters carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Metric tokeniser and answer normaliser patterns (Unicode word classes).
TOKEN_DROP = r"(?U)[^\w\s']"          # everything but word characters, spaces and apostrophes
ARTICLES = r"(?U)\b(a|an|the)\b"
PUNCT = r"(?U)[^\w\s]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                 "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()``: leading / trailing Unicode whitespace removed (Spark's ``trim``
    removes spaces only); a character-set trim, no regex engine."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def squeeze_ws(c) -> Column:
    """Runs of whitespace -> one space, trimmed (``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(col_(c), r"(?U)\s+", " "))


def metric_tokens(c) -> Column:
    """M-01 metric tokeniser: lower, strip, non word/space/apostrophe -> space, split.

    Returns ARRAY<STRING> without empty tokens; NULL text gives an empty array.
    """
    cleaned = F.regexp_replace(F.trim(F.lower(F.coalesce(col_(c), F.lit("")))), TOKEN_DROP, " ")
    return F.filter(F.split(F.trim(cleaned), r"(?U)\s+"), lambda t: t != "")


def word_count(c) -> Column:
    """X-10 whitespace word count (``len(s.split())``); blank / NULL -> 0."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), r"(?U)\s+")
    return F.size(F.filter(parts, lambda t: t != "")).cast("bigint")


def ngrams(tokens, n: int) -> Column:
    """M-02 n-grams of a token array as space-joined strings (empty when too short).

    ``sequence`` counts down when its stop is below its start, so short arrays are guarded.
    """
    t = col_(tokens)
    return F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                    lambda i: F.array_join(F.slice(t, i, n), "\u0001")),
    ).otherwise(F.array().cast("array<string>"))


def normalize_answer(c) -> Column:
    """M-08 answer normaliser: lower, articles -> space, drop punctuation, squeeze spaces."""
    t = F.lower(F.coalesce(col_(c), F.lit("")))
    t = F.regexp_replace(t, ARTICLES, " ")
    t = F.regexp_replace(t, PUNCT, "")
    return squeeze_ws(t)


def normalize_text(c) -> Column:
    """D-07: drop control chars (keep \\n, \\t, \\r), runs of whitespace other than newlines -> one
    space, 3+ newlines -> 2, strip all surrounding whitespace."""
    t = F.regexp_replace(col_(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


# Chat markup rewrites, applied in this order (pattern, replacement).
CHAT_CLEAN_RULES = [
    (r"<@[A-Z0-9]+>", ""),
    (r"<#[A-Z0-9]+\|([^>]+)>", "#$1"),
    (r"<(https?://[^|>]+)\|([^>]+)>", "$2"),
    (r"<(https?://[^>]+)>", "$1"),
    (r"<!(?:here|channel|everyone)[^>]*>", ""),
]


def clean_chat_text(c) -> Column:
    """D-08 chat text cleaner: mentions out, channel refs -> #name, links -> label or URL,
    broadcast commands out, whitespace squeezed. NULL -> ''."""
    t = F.coalesce(col_(c), F.lit(""))
    for pattern, replacement in CHAT_CLEAN_RULES:
        t = F.regexp_replace(t, pattern, replacement)
    return squeeze_ws(t)


def stable_hash01(*cols) -> Column:
    """Deterministic draw in [0, 1) from the given columns (seeded randomness, D9)."""
    h = F.xxhash64(*[col_(c) for c in cols])
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def sha_bucket(c, modulus: int = 10000) -> Column:
    """First 4 bytes of sha256(text) as an unsigned int, modulo ``modulus``."""
    first8 = F.substring(F.sha2(col_(c), 256), 1, 8)
    return F.pmod(F.conv(first8, 16, 10).cast("bigint"), F.lit(modulus))
