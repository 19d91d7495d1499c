"""D-09 HTML rules as native column functions, for the profiles that do not depend on nesting.

Pages are read by patterns: skipped elements are cut out up to the first end tag (as the rule itself
does), break tags become line breaks, other tags go, references are decoded; an element left open is cut
to the end of the page. ``page_tree`` holds what needs nesting: the ``site`` profile and D-12.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip

# Tag sets of the HTML-to-text profiles.
WIKI_SKIP = ("script", "style", "noscript")
WIKI_BREAK = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
SITE_DROP = ("script", "style", "nav", "footer", "header")
# Named character references that are decoded.
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("copy", "\u00a9"), ("reg", "\u00ae"),
              ("middot", "\u00b7"), ("hellip", "\u2026"), ("ndash", "\u2013"), ("mdash", "\u2014"), ("lsquo", "\u2018"),
              ("rsquo", "\u2019"), ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("amp", "&"))
TAG = r"<[a-zA-Z/!?][^>]*>"
# Openings of a question.
QUESTION_STARTS = ("how", "what", "why", "when", "where", "can", "do")


def without(html: Column, tags) -> Column:
    """``html`` without the named elements and their content."""
    cut = lambda h, t: F.regexp_replace(h, rf"(?is)<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)", "")
    return reduce(cut, tags, F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", ""))


def decoded(text: Column) -> Column:
    """Numeric references (decimal and hexadecimal), then the named ones."""
    def numeric(p, i):
        digits = F.regexp_extract(p, r"^#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));", 1)
        hexes = F.regexp_extract(p, r"^#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));", 2)
        code = F.when(digits != "", digits.cast("long")).otherwise(F.conv(hexes, 16, 10).cast("long"))
        known = (i > 0) & ((digits != "") | (hexes != "")) & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(known, F.concat(char, F.regexp_replace(p, r"^#[0-9a-fA-FxX]+;", ""))) \
            .otherwise(F.when(i > 0, F.concat(F.lit("&"), p)).otherwise(p))

    text = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&", -1), numeric), "")).otherwise(text)
    return reduce(lambda t, r: F.replace(t, F.lit(f"&{r[0]};"), F.lit(r[1])), REFERENCES, text)


def html_title(html) -> Column:
    """Text of the first title element; NULL if there is none."""
    h = col_(html)
    return F.when(h.rlike(r"(?is)<title\b[^>]*>"), decoded(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)", 1)))


def html_to_text(html, profile: str = "wiki") -> Column:
    """``wiki``: skipped elements out, break tags to line breaks, blank lines squeezed, stripped;
    ``strip``: tags out. NULL pages give the empty text."""
    h = F.coalesce(col_(html), F.lit(""))
    if profile == "wiki":
        broken = F.regexp_replace(without(h, WIKI_SKIP), rf"(?i)<(?:{'|'.join(WIKI_BREAK)})\b[^>]*>", "\n")
        return py_strip(F.regexp_replace(decoded(F.regexp_replace(broken, TAG, "")), r"\n\s*\n", "\n\n"))
    if profile == "strip":
        return decoded(F.regexp_replace(F.regexp_replace(h, r"(?s)<!--.*?(?:-->|\z)", ""), TAG, ""))
    raise ValueError(f"unknown profile {profile}")
