"""D-09 / D-12 rules that need the nesting of a page: one scan over its tags, as Arrow-batched kernels.

Tags are read in order with a stack of open elements. An end tag closes the innermost open element of its
name with all that is open inside; one that fits none is passed over; what is still open at the end ends
there. An element is kept as the range of its text pieces and of the elements below it, so that its text
and its descendants are slices.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import QUESTION_STARTS, SITE_DROP
from .kernels import in_pieces

# Elements that never hold anything, and those whose content is no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style")
# Classes and attributes of the FAQ miner.
SCHEMA_TYPE = re.compile(r"FAQPage|Question", re.I)
FAQ_CLASS = re.compile(r"faq|accordion|toggle", re.I)
QUESTION_CLASS = re.compile(r"question|title|header", re.I)
ANSWER_CLASS = re.compile(r"answer|content|body", re.I)

# Nothing follows the last group but the end of the tag or of the page, so a match never goes back.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


def _attributes(raw: str) -> dict:
    return {k.lower(): unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in ATTRIBUTE.findall(raw)}


class Page:
    """Text pieces and elements of one page outside the elements named in ``drop``."""

    def __init__(self, html: str, drop=SITE_DROP):
        self.pieces: list[str] = []         # stripped, empty ones left out
        self.tags: list[str] = []           # elements in page order
        self.attrs: list[dict] = []
        self.first: list[int] = []          # pieces [first, end) and elements (i, last) lie inside element i
        self.end: list[int] = []
        self.last: list[int] = []
        self.parent: list[int] = []
        self._scan(html, drop)

    def _scan(self, html: str, drop) -> None:
        open_tags: list[tuple[str, int]] = []       # (name, element or -1 inside a dropped one)
        count: dict[str, int] = {}
        dropped = at = 0

        def text(upto):
            if not dropped and upto > at and (piece := unescape(html[at:upto]).strip()):
                self.pieces.append(piece)

        while (m := TOKEN.search(html, at)) is not None:
            text(m.start())
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                while count.get(tag):
                    name, i = open_tags.pop()
                    count[name] -= 1
                    dropped -= name in drop
                    if i >= 0:
                        self.end[i], self.last[i] = len(self.pieces), len(self.tags)
                    if name == tag:
                        break
                continue
            whole = m[3].endswith("/") or tag in VOID
            if not dropped and tag not in drop:
                i = len(self.tags)
                self.tags.append(tag)
                self.attrs.append(_attributes(m[3]) if "=" in m[3] else {})
                self.first.append(len(self.pieces))
                self.end.append(len(self.pieces))
                self.last.append(i + 1)
                self.parent.append(open_tags[-1][1] if open_tags else -1)
            else:
                i = -1
            if whole:
                continue
            open_tags.append((tag, i))
            count[tag] = count.get(tag, 0) + 1
            dropped += tag in drop
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                at = end.start() if end else len(html)
        text(len(html))
        for _, i in open_tags:
            if i >= 0:
                self.end[i], self.last[i] = len(self.pieces), len(self.tags)

    def text(self, i: int) -> str:
        return "".join(self.pieces[self.first[i]:self.end[i]])

    def where(self, name: str, fits) -> list[int]:
        """Elements whose attribute ``name`` is there and fits."""
        return [i for i, a in enumerate(self.attrs) if name in a and fits(a[name])]

    def below(self, i: int, some: list[int]) -> int | None:
        """The first of ``some`` inside element ``i``."""
        k = bisect_left(some, i + 1)
        return some[k] if k < len(some) and some[k] < self.last[i] else None

    def paragraphs_after(self, i: int) -> list[str]:
        """Texts of the paragraphs among the later siblings of a heading, up to the next heading."""
        out, j = [], self.last[i]
        while j < len(self.tags) and self.parent[j] == self.parent[i] and self.tags[j] not in ("h1", "h2", "h3", "h4"):
            if self.tags[j] == "p":
                out.append(self.text(j))
            j = self.last[j]
        return out


def site_text(html: str | None) -> str:
    """Text pieces outside dropped elements, joined by line breaks; NULL and empty pages give ''."""
    return "\n".join(Page(html).pieces) if html else ""


def faq_pairs(html: str | None) -> list[tuple[str, str, str]]:
    """(question, answer, pattern) by schema markup, by accordion classes, then by question headings."""
    if not html:
        return []
    page, out = Page(html), []

    def inside(outer, questions, answers, name):
        for i in outer:
            q, a = page.below(i, questions), page.below(i, answers)
            if q is not None and a is not None:
                out.append((page.text(q), page.text(a), name))

    inside(page.where("itemtype", SCHEMA_TYPE.search), page.where("itemprop", "name".__eq__),
           page.where("itemprop", "acceptedAnswer".__eq__), "schema")
    inside(page.where("class", FAQ_CLASS.search), page.where("class", QUESTION_CLASS.search),
           page.where("class", ANSWER_CLASS.search), "accordion")
    for i, tag in enumerate(page.tags):
        if tag in ("h2", "h3", "h4"):
            q = page.text(i)
            if ("?" in q or q.lower().startswith(QUESTION_STARTS)) and (a := " ".join(page.paragraphs_after(i))[:1000]):
                out.append((q, a, "heading"))
    return out


@F.pandas_udf(T.StringType())
def site_text_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """D-09 ``site`` profile of batches of pages."""
    return in_pieces(batches, site_text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("q", "a", "pattern")])))
def faq_pairs_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """D-12 structural pairs of batches of pages."""
    return in_pieces(batches, lambda h: [{"q": q, "a": a, "pattern": p} for q, a, p in faq_pairs(h)])
