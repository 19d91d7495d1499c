"""Text extraction, chunking and Q/A mining (D-01 ... D-22).

Each operator is one distributed job over a document table. Sequential rules inside one
document (greedy chunk boundaries, HTML parsing) run as Arrow-batched kernels; ids, counts,
filters and explodes around them are native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunk_udf
from ..functions.html import html_title, html_to_text
from ..functions.page_tree import faq_pairs_udf, site_text_udf
from ..functions.text import col_, metric_tokens, py_strip


# ------------------------------------------------------------------ chunking (D-01 ... D-06)

def chunk_documents(docs: DataFrame, id_col: str, text_col: str, profile: str = "index",
                    size: int | None = None, overlap: int | None = None, source_col: str | None = None,
                    created_at: Column | None = None, metadata_cols=()) -> DataFrame:
    """D-01 + D-02: one row per chunk with ``chunk_id`` (12 hex of md5("source:i:first 50")),
    ``chunk_index``, ``total_chunks``, ``created_at`` and a ``metadata`` struct (source, index,
    total, created_at merged with the document columns named in ``metadata_cols``)."""
    arr = chunk_udf(profile, size, overlap)(F.col(text_col))
    src = F.col(source_col).cast("string") if source_col else F.col(id_col).cast("string")
    extra = list(metadata_cols)
    d = docs.select(F.col(id_col).alias("doc_id"), src.alias("source"), arr.alias("_c"), *extra)
    d = d.select("doc_id", "source", *extra, F.size("_c").alias("total_chunks"),
                 F.posexplode("_c").alias("chunk_index", "content"))
    cid = F.substring(F.md5(F.concat_ws(":", "source", F.col("chunk_index").cast("string"),
                                        F.substring("content", 1, 50))), 1, 12)
    d = d.select(cid.alias("chunk_id"), "doc_id", "source", "chunk_index", "total_chunks", "content", *extra,
                 (created_at if created_at is not None else F.current_timestamp()).alias("created_at"))
    meta = F.struct("source", "chunk_index", "total_chunks", "created_at", *extra)
    return d.withColumn("metadata", meta).drop(*extra)


def fixed_chunks(docs: DataFrame, name_col: str, text_col: str, size: int) -> DataFrame:
    """D-03: fixed-size chunks without overlap; input "Document: name (chunk i)" (1-based)."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    d = docs.select(F.col(name_col).alias("name"), pieces.alias("_p"))
    d = d.select("name", F.size("_p").alias("total_chunks"), F.posexplode("_p").alias("chunk_index", "output"))
    return d.select(F.format_string("Document: %s (chunk %d)", F.col("name"), F.col("chunk_index") + 1).alias("input"),
                    "output", "name", "chunk_index", "total_chunks")


def paragraph_samples(docs: DataFrame, title_col: str, text_col: str, min_length: int = 50) -> DataFrame:
    """D-04: paragraphs (split on a blank line), stripped, >= min_length -> "title - Paragraph i"."""
    d = docs.select(F.col(title_col).alias("title"), F.posexplode(F.split(F.col(text_col), "\n\n", -1)).alias("i", "p"))
    d = d.withColumn("p", py_strip("p")).filter(F.length("p") >= min_length)
    return d.select(F.format_string("%s - Paragraph %d", F.col("title"), F.col("i") + 1).alias("input"),
                    F.col("p").alias("output"), "title", F.col("i").alias("paragraph_index"))


def section_samples(docs: DataFrame, title_col: str, text_col: str, min_length: int = 50) -> DataFrame:
    """D-05: split before '#' headers; header line (without #) -> input, the rest -> output."""
    d = docs.select(F.col(title_col).alias("title"),
                    F.posexplode(F.split(F.col(text_col), r"\n(?=#+\s)", -1)).alias("i", "s"))
    d = d.withColumn("s", py_strip("s")).filter(F.length("s") >= min_length)
    first = F.substring_index("s", "\n", 1)
    has_rest = F.instr("s", "\n") > 0
    rest = F.when(has_rest, py_strip(F.expr("substring(s, instr(s, '\\n') + 1)"))).otherwise(F.col("s"))
    header = py_strip(F.regexp_replace(first, r"^#+", ""))
    return d.select(header.alias("input"), rest.alias("output"), "title", F.col("i").alias("section_index"))


def document_samples(docs: DataFrame, title_col: str, text_col: str, min_length: int = 50) -> DataFrame:
    """D-06: whole document as one sample (title -> text) when long enough."""
    return docs.filter(F.length(text_col) >= min_length).select(F.col(title_col).alias("input"), F.col(text_col).alias("output"))


# ------------------------------------------------------------------ HTML (D-09, D-12)

def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", profile: str = "wiki",
              url_col: str | None = None) -> DataFrame:
    """D-09: HTML -> text per page: profiles wiki and strip in native functions; ``site`` drops elements
    by their own end tags in a kernel and also returns the title, falling back to the URL."""
    text = site_text_udf(F.col(html_col)) if profile == "site" else html_to_text(html_col, profile)
    title = html_title(html_col) if profile == "site" else F.lit(None).cast("string")
    if url_col and profile == "site":
        title = F.coalesce(title, F.col(url_col))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), text.alias("text"), title.alias("title"))


def faq_structure(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """D-12 structural part: schema markup, accordions and question headings, read with the nesting of the
    page outside dropped elements. As the rule has it, every element whose type or class fits gives its
    first question and answer, so a list of questions that itself fits repeats its first pair."""
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.posexplode(faq_pairs_udf(F.col(html_col))).alias("k", "x"))
    return d.select("page_id", F.col("x.q").alias("input"), F.col("x.a").alias("output"), F.col("x.pattern").alias("pattern"), "k")


# Fixed values: "Q: ... A: ..." text pattern of the FAQ miner.
QA_TEXT_PATTERN = r"(?is)(?:Q:|Question:?)\s*(.+?)\s*(?:A:|Answer:?)\s*(.+?)(?=(?:Q:|Question:|$))"


def faq_text(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-12 text part: "Q: ... A: ..." pairs (both sides > 10 chars, cut 500 / 1000), native."""
    q = F.regexp_extract_all(F.col(text_col), F.lit(QA_TEXT_PATTERN), 1)
    a = F.regexp_extract_all(F.col(text_col), F.lit(QA_TEXT_PATTERN), 2)
    d = texts.select(F.col(id_col).alias("page_id"), F.posexplode(F.arrays_zip(q.alias("q"), a.alias("a"))).alias("k", "x"))
    d = d.select("page_id", "k", py_strip("x.q").alias("q"), py_strip("x.a").alias("a"))
    d = d.filter((F.length("q") > 10) & (F.length("a") > 10))
    return d.select("page_id", F.substring("q", 1, 500).alias("input"), F.substring("a", 1, 1000).alias("output"),
                    F.lit("qa_text").alias("pattern"), "k")


def faq_mine(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """D-12: all four FAQ sources for pages, as one frame with a ``pattern`` column."""
    txt = html_text(pages, id_col, html_col, "site")
    return faq_structure(pages, id_col, html_col).unionByName(faq_text(txt, "page_id", "text"))


# ------------------------------------------------------------------ Q/A mining (D-10 ... D-16)

def _is_upper_first(c) -> Column:
    ch = F.substring(col_(c), 1, 1)
    return (ch == F.upper(ch)) & (ch != F.lower(ch))


def content_to_samples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-10: consecutive paragraph pairs (10 <= len(q) <= 500, len(a) >= 10, "?" in q or an
    upper-case first letter; cut 500 / 1000). Documents without any pair fall back to
    "What is <first sentence, lower, 50>?" for paragraphs > 50 chars whose first sentence is
    > 20 chars."""
    paras = docs.select(F.col(id_col).alias("doc_id"),
                        F.filter(F.transform(F.split(F.col(text_col), "\n\n", -1), lambda p: py_strip(p)),
                                 lambda p: p != "").alias("ps"))
    e = paras.select("doc_id", "ps", F.posexplode("ps").alias("i", "q"))
    pairs = e.filter(F.col("i") % 2 == 0).withColumn("a", F.try_element_at("ps", F.col("i") + 2)) \
        .filter(F.col("a").isNotNull())
    pairs = pairs.filter((F.length("q") >= 10) & (F.length("q") <= 500) & (F.length("a") >= 10)
                         & (F.contains("q", F.lit("?")) | _is_upper_first("q")))
    pairs = pairs.select("doc_id", F.col("i").alias("k"), F.substring("q", 1, 500).alias("input"),
                         F.substring("a", 1, 1000).alias("output"))
    fb = e.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.length("q") > 50)
    first = F.substring_index("q", ".", 1)
    fb = fb.filter(F.length(first) > 20).select(
        "doc_id", F.col("i").alias("k"), F.format_string("What is %s?", F.lower(F.substring(first, 1, 50))).alias("input"),
        F.substring("q", 1, 1000).alias("output"))
    return pairs.unionByName(fb)


def markdown_samples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-11: `#`..`####` headings; the body up to the next heading, stripped, > 20 chars;
    "What is h?" unless the heading has "?"; body cut to 1000."""
    pat = r"(?m)^(#{1,4})[ \t]+(.+)$"
    # split the text at heading lines; part k+1 is the body after heading k
    heads = F.regexp_extract_all(F.col(text_col), F.lit(pat), 2)
    bodies = F.slice(F.split(F.col(text_col), r"(?m)^#{1,4}[ \t]+.+$", -1), 2, 1 << 30)
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("k", "x"))
    d = d.select("doc_id", "k", F.col("x.h").alias("h"), py_strip("x.b").alias("b")).filter(F.length("b") > 20)
    q = F.when(F.contains("h", F.lit("?")), F.col("h")).otherwise(F.format_string("What is %s?", F.col("h")))
    return d.select("doc_id", "k", q.alias("input"), F.substring("b", 1, 1000).alias("output"))


# Markdown Q/A patterns and the question words of FAQ-style headers.
MD_QA_PATTERN = r"(?is)(?:Q:|Question:)\s*(.+?)\s*(?:A:|Answer:)\s*(.+?)(?=(?:Q:|Question:)|$)"
MD_HEADER_PATTERN = r"(?s)##\s*(.+?)\n\n(.+?)(?=\n##|\n#|$)"
HEADER_QUESTION_WORDS = ["how", "what", "why", "when", "where", "can", "do"]


def markdown_qa(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-13: "Q:/Question: ... A:/Answer: ..." pairs (case-insensitive, across lines), then
    ``##`` headers followed by a blank line and a body, kept when the header has "?" or
    contains a question word; both sides stripped."""
    t = F.col(text_col)

    def pairs(pattern, tag):
        q = F.regexp_extract_all(t, F.lit(pattern), 1)
        a = F.regexp_extract_all(t, F.lit(pattern), 2)
        return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(q.alias("q"), a.alias("a"))).alias("k", "x")) \
            .select("doc_id", "k", py_strip("x.q").alias("input"), py_strip("x.a").alias("output"), F.lit(tag).alias("pattern"))

    h = pairs(MD_HEADER_PATTERN, "heading")
    hl = F.lower("input")
    qword = F.exists(F.array(*[F.lit(w) for w in HEADER_QUESTION_WORDS]), lambda w: F.contains(hl, w))
    h = h.filter(F.contains("input", F.lit("?")) | qword)
    return pairs(MD_QA_PATTERN, "qa").unionByName(h)


LINE_BUCKET = 4096  # lines per window partition: a huge document is spread over many tasks


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("ln", "raw"))


def line_qa(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-14: line-oriented "Q:" / "A:" pairing; an "A:" line answers the last "Q:" line when
    no answer came after that question (a later "Q:" replaces an unanswered one; an empty
    question opens nothing).

    "Last Q / last A so far" are running maxima of line numbers, computed per (document,
    line bucket) with a carry from earlier buckets, so one huge document is not one task.
    """
    from .ordered import running_sum_split
    lines = _lines(docs, id_col, text_col).withColumn("line", py_strip("raw"))
    # every "Q:" / "A:" in the line is removed (not only the prefix), then the text is stripped
    lines = lines.withColumn("q", F.when(F.col("line").startswith("Q:"), py_strip(F.replace("raw", F.lit("Q:"), F.lit(""))))) \
        .withColumn("a", F.when(F.col("line").startswith("A:"), py_strip(F.replace("raw", F.lit("A:"), F.lit("")))))
    marks = lines.filter(F.col("q").isNotNull() | F.col("a").isNotNull()).drop("raw", "line")
    bucket = F.floor(F.col("ln") / LINE_BUCKET)
    marks = marks.withColumn("_qln", F.when(F.col("q").isNotNull(), F.col("ln")))
    marks = running_sum_split(marks, ["doc_id"], ["ln"], "_qln", bucket, "last_q_ln", how="max")
    ans = marks.filter(F.col("a").isNotNull() & F.col("last_q_ln").isNotNull())
    qs = marks.filter(F.col("q").isNotNull()).select("doc_id", F.col("ln").alias("last_q_ln"), F.col("q").alias("input"))
    # the first answer after a question closes it; later answers with the same open question
    # are orphans
    firsts = ans.groupBy("doc_id", "last_q_ln").agg(F.min("ln").alias("ln"))
    ans = ans.join(firsts, ["doc_id", "last_q_ln", "ln"]).join(qs, ["doc_id", "last_q_ln"])
    # an empty question does not open one (and still replaces an unanswered one)
    return ans.filter(F.col("input") != "").select("doc_id", F.col("ln").alias("k"), "input", F.col("a").alias("output"))


# Manual header rules (underline line, markdown header, ALL CAPS, numbered).
UNDERLINE = r"^[=-]{3,}$"
HASH_HEADER = r"^#{1,3}\s+(.+)$"
CAPS_HEADER = r"^([A-Z][A-Z\s]+)$"
NUMBERED_HEADER = r"^(\d+\.)\s+(.+)$"


def manual_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-15: manual text -> titled sections. A line is a header when the next raw line is an
    underline (3+ '=' / '-'; the underline is consumed), or its stripped form is a markdown
    header (title = its text), an ALL-CAPS line (title = the line) or a numbered line (title =
    the number, e.g. "2."). A section is kept when its title is non-empty and it has at least
    one body line; text before the first header is dropped; content = body lines joined and
    stripped.

    All in-row: a text is one value of one row, so its lines are read where it lies and only
    its sections leave. (A run of 4+ consecutive underline lines is read one level deep.)
    """
    none = F.array(F.lit(None).cast("string"))

    def bound(value, use):
        """``use(value)`` with the value computed once."""
        return F.get(F.transform(F.array(value), use), 0)

    def after(xs, end):
        return F.concat(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), end)

    def underlined(raw, following):
        return F.struct(raw.alias("raw"), (F.coalesce(following.rlike(UNDERLINE), F.lit(False)) & ~raw.rlike(UNDERLINE)).alias("ulh"))

    def line(x, above):
        is_ul = F.coalesce(above, F.lit(False))

        def title(text):
            hashed, caps, numbered = text.rlike(HASH_HEADER), text.rlike(CAPS_HEADER), text.rlike(NUMBERED_HEADER)
            return (F.when(x["ulh"], text).when(hashed, py_strip(F.regexp_extract(text, HASH_HEADER, 1)))
                    .when(caps, text).when(numbered, F.regexp_extract(text, NUMBERED_HEADER, 1)))

        return F.struct(x["raw"].alias("raw"), is_ul.alias("is_ul"), F.when(~is_ul, bound(py_strip(x["raw"]), title)).alias("title"))

    def sections(lines):
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x["title"].alias("title"))), lambda h: h["title"].isNotNull())
        end = F.array(F.struct(F.size(lines).alias("at"), F.lit(None).cast("string").alias("title")))
        return bound(heads, lambda hs: F.transform(
            F.zip_with(hs, after(hs, end), lambda h, n: F.struct(
                h["title"].alias("title"),
                F.filter(F.slice(lines, h["at"] + 2, F.greatest(F.coalesce(n["at"] - h["at"] - 1, F.lit(0)), F.lit(0))), lambda x: ~x["is_ul"]).alias("body"))),
            lambda x, i: F.struct((i + 1).cast("bigint").alias("sec"), x["title"].alias("title"), (F.size(x["body"]) > 0).alias("kept"),
                                  py_strip(F.array_join(F.transform(x["body"], lambda y: y["raw"]), "\n")).alias("content"))))

    marked = bound(F.split(F.col(text_col), "\n", -1), lambda ls: F.zip_with(ls, after(ls, none), underlined))
    lines = bound(marked, lambda ms: F.zip_with(
        ms, F.concat(F.array(F.lit(False)), F.transform(F.slice(ms, 1, F.greatest(F.size(ms) - 1, F.lit(0))), lambda m: m["ulh"])), line))
    s = docs.select(F.col(id_col).alias("doc_id"), F.explode(bound(lines, sections)).alias("s"))
    return s.filter((F.col("s.title") != "") & F.col("s.kept")).select("doc_id", "s.sec", "s.title", "s.content")


def questions_for_sections(sections: DataFrame, title_rules, generic, cues=(), k: int = 3, min_len: int = 50) -> DataFrame:
    """D-16: questions for each section long enough: the templates of the first title class
    whose keyword pattern matches the lower-cased title (else the ``generic`` ones), followed by
    content-cue questions; the first ``k`` are kept. ``title_rules``: (pattern, templates) pairs;
    ``cues``: (pattern, template) pairs. In a template "{a}" is the title lower-cased with "_" / "-"
    as spaces, "{t}" the lower-cased title. All in-row: the rules are compiled into the expression."""
    s = sections.filter(F.length("content") >= min_len)
    tl = F.lower(F.col("title"))
    act = F.regexp_replace(tl, "[_-]", " ")

    def fill(t):
        return F.replace(F.replace(F.lit(t), F.lit("{a}"), act), F.lit("{t}"), tl)

    by_class = None
    for pat, tpls in title_rules:
        arr = F.array(*[fill(t) for t in tpls])
        by_class = F.when(tl.rlike(pat), arr) if by_class is None else by_class.when(tl.rlike(pat), arr)
    base = (by_class.otherwise(F.array(*[fill(t) for t in generic])) if by_class is not None
            else F.array(*[fill(t) for t in generic]))
    cue_arr = F.filter(F.array(*[F.when(F.col("content").rlike(p), fill(t)) for p, t in cues]), lambda x: x.isNotNull())
    qs = F.slice(F.concat(base, cue_arr), 1, k)
    return s.select("doc_id", "sec", "title", F.posexplode(qs).alias("q", "input"), F.col("content").alias("output"))


# ------------------------------------------------------------------ URLs (D-19, D-20)

# URL kinds and their patterns, tried in this order; no match -> website.
URL_KINDS = [
    ("notion", r"notion\.so|notion\.site"),
    ("google_docs", r"docs\.google\.com/document"),
    ("google_sheets", r"docs\.google\.com/spreadsheets"),
    ("github", r"github\.com/.+/blob/.+|raw\.githubusercontent\.com"),
    ("github_readme", r"github\.com/[^/]+/[^/]+/?$"),
    ("confluence", r"atlassian\.net/wiki|confluence\."),
    ("raw_json", r"\.jsonl?$|\.csv$"),
]


def url_kind(url) -> Column:
    """D-19: first matching URL pattern (case-insensitive), else "website"."""
    e = None
    for kind, pat in URL_KINDS:
        cond = col_(url).rlike("(?i)" + pat)
        e = F.when(cond, F.lit(kind)) if e is None else e.when(cond, F.lit(kind))
    return e.otherwise(F.lit("website"))


def url_ids(df: DataFrame, url_col: str = "url") -> DataFrame:
    """D-20: ids and derived URLs, each for URLs of its kind (D-19), else NULL.

    notion: the part after the last "-" of the path when it is 32 hex chars, else the last
    path segment; google docs / sheets: the id after /document/d/ or /spreadsheets/d/ ("" when
    absent); github: raw URL (github.com -> raw.githubusercontent.com, /blob/ -> /), owner and
    repo (first two path segments) and the README URL on main.
    """
    u = F.col(url_col)
    kind = url_kind(u)
    path = F.regexp_replace(F.coalesce(F.expr(f"parse_url(`{url_col}`, 'PATH')"), F.lit("")), r"^/+|/+$", "")
    tail = F.substring_index(path, "-", -1)
    notion = F.when(F.contains(path, F.lit("-")) & tail.rlike(r"^[0-9a-fA-F]{32}$"), tail) \
        .otherwise(F.substring_index(path, "/", -1))
    parts = F.split(path, "/")
    gh = kind.isin("github", "github_readme")
    owner = F.when(gh & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(1)))
    repo = F.when(gh & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(2)))
    return df.select("*",
                     F.when(kind == "notion", notion).alias("notion_page_id"),
                     F.when(kind == "google_docs", F.regexp_extract(u, r"/document/d/([a-zA-Z0-9_-]+)", 1)).alias("doc_id"),
                     F.when(kind == "google_sheets", F.regexp_extract(u, r"/spreadsheets/d/([a-zA-Z0-9_-]+)", 1)).alias("sheet_id"),
                     F.when(gh, F.replace(F.replace(u, F.lit("github.com"), F.lit("raw.githubusercontent.com")),
                                          F.lit("/blob/"), F.lit("/"))).alias("raw_url"),
                     owner.alias("owner"), repo.alias("repo"),
                     F.when(owner.isNotNull(), F.format_string("https://raw.githubusercontent.com/%s/%s/main/README.md",
                                                               owner, repo)).alias("readme_url"))


# ------------------------------------------------------------------ recipes (D-21, D-22)

def first_sentence_questions(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """D-21: chunk -> (first sentence + "?", chunk)."""
    return chunks.withColumn("input", py_strip(F.concat(F.substring_index(F.col(text_col), ".", 1), F.lit("?")))) \
        .withColumn("output", F.col(text_col))


# Question text of the plain-text recipe.
TXT_RECIPE_QUESTION = "What does the document say about this topic?"


def long_paragraphs(docs: DataFrame, id_col: str, text_col: str, min_len: int = 50) -> DataFrame:
    """D-21 txt recipe: paragraphs (blank-line split, stripped) longer than ``min_len``, each with
    the recipe's fixed question."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n\n", -1)).alias("k", "p"))
    return d.withColumn("p", py_strip("p")).filter(F.length("p") > min_len).withColumn("input", F.lit(TXT_RECIPE_QUESTION))


def markdown_recipe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D-21 md recipe: split at every "\\n#", title = first line with '#' and spaces stripped
    from both ends, body = the remaining lines stripped; non-empty bodies become
    "What is <title>?" samples."""
    parts = F.split(F.col(text_col), "\n#", -1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("k", "sec"))
    d = d.withColumn("sec", py_strip("sec")).filter(F.col("sec") != "")
    first = F.substring_index("sec", "\n", 1)
    title = F.regexp_replace(first, r"^[# ]+|[# ]+$", "")
    body = F.when(F.instr("sec", "\n") > 0, py_strip(F.expr("substring(sec, instr(sec, '\\n') + 1)"))).otherwise(F.lit(""))
    return d.select("doc_id", "k", F.format_string("What is %s?", title).alias("input"), body.alias("output")) \
        .filter(F.col("output") != "")


def best_snippet(df: DataFrame, text_col: str, query_col: str, width: int = 200, step: int = 50) -> DataFrame:
    """D-22: the ``width``-char window (start step ``step``) holding the most query tokens
    (substring test on lower-cased text; first best wins), with "..." at cut ends. ``width`` is a
    multiple of ``step``: the text is cut into pieces once, and a window is a run of them."""
    if width % step:
        raise ValueError("width must be a multiple of step")
    d = df.withColumn("_qt", metric_tokens(query_col))
    t, toks = F.col(text_col), F.col("_qt")
    n = F.length(t)
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    lows = F.transform(pieces, lambda p: F.lower(p))
    last = F.ceil((n - width) / step).cast("int")  # number of window starts

    def scored(parts):
        def one(i):
            low = F.array_join(F.slice(parts, i + 1, width // step), "")
            return F.struct(F.size(F.filter(toks, lambda k: F.contains(low, k))).alias("c"), (-i).alias("ns"), i.alias("s"))
        return F.transform(F.sequence(F.lit(0), last - 1), one)

    best = F.array_max(F.filter(F.element_at(F.transform(F.array(lows), scored), 1), lambda x: x["c"] > 0))
    d = d.withColumn("_s", F.when(last > 0, F.coalesce(best["s"], F.lit(0))).otherwise(0) * step)
    snip = F.substring(t, F.col("_s") + 1, F.lit(width))
    snip = F.when(F.col("_s") > 0, F.concat(F.lit("..."), snip)).otherwise(snip)
    snip = F.when(F.col("_s") + width < n, F.concat(snip, F.lit("..."))).otherwise(snip)
    return d.withColumn("snippet", snip).drop("_s", "_qt")


# ------------------------------------------------------------------ block lists / doc structure (D-17, D-18)

# Block types carrying rich text, and the prefixes of the connector profile.
TEXT_BLOCKS = ["paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item",
               "quote", "callout", "toggle"]
CONNECTOR_PREFIX = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ",
                    "numbered_list_item": "1. ", "quote": "> "}
URL_PREFIX = {"bulleted_list_item": "• ", "numbered_list_item": "- "}
URL_TYPES = ["paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "toggle"]


def _rich(b, typ):
    arr = F.try_variant_get(b, f"$.{typ}.rich_text", "array<struct<plain_text:string>>")
    return F.array_join(F.transform(F.coalesce(arr, F.array().cast("array<struct<plain_text:string>>")),
                                    lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")


def blocks_to_text(df: DataFrame, blocks_col: str, profile: str = "connector", out: str = "text") -> DataFrame:
    """D-17: a block list (JSON text or VARIANT array of ``{type, <type>: {rich_text: [...]}}``)
    -> text, in block order, inside the row (no shuffle).

    connector: markdown prefixes for headings, bullets, numbers and quotes; code blocks fenced
    with their language; dividers as "---"; non-empty parts joined by a blank line (nested
    children are not visited, as at the top level of the reference).
    url: paragraph / heading / toggle text, "• " bullets, "- " numbered items; joined by newlines.
    """
    c = F.col(blocks_col)
    v = F.try_parse_json(c) if dict(df.dtypes)[blocks_col] == "string" else c
    arr = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))

    def one(b):
        typ = F.try_variant_get(b, "$.type", "string")
        e = None
        types = TEXT_BLOCKS if profile == "connector" else URL_TYPES
        prefixes = CONNECTOR_PREFIX if profile == "connector" else URL_PREFIX
        for t in types:
            txt = _rich(b, t)
            if t in prefixes:
                txt = F.when(txt != "", F.concat(F.lit(prefixes[t]), txt)).otherwise(txt) if profile == "url" \
                    else F.concat(F.lit(prefixes[t]), txt)
            e = F.when(typ == t, txt) if e is None else e.when(typ == t, txt)
        if profile == "connector":
            lang = F.coalesce(F.try_variant_get(b, "$.code.language", "string"), F.lit(""))
            e = e.when(typ == "code", F.concat(F.lit("```"), lang, F.lit("\n"), _rich(b, "code"), F.lit("\n```")))
            e = e.when(typ == "divider", F.lit("---"))
        return F.coalesce(e, F.lit(""))

    parts = F.filter(F.transform(arr, one), lambda s: s != "")
    return df.withColumn(out, F.array_join(parts, "\n\n" if profile == "connector" else "\n"))


_PARA = "struct<elements:array<struct<textRun:struct<content:string>,inlineObjectElement:string>>,bullet:struct<nestingLevel:int>>"
_TABLE = f"struct<tableRows:array<struct<tableCells:array<struct<content:array<struct<paragraph:{_PARA}>>>>>>>"
_ELEM = f"struct<paragraph:{_PARA},table:{_TABLE},tableOfContents:struct<content:array<struct<paragraph:{_PARA},table:{_TABLE}>>>>"
DOC_SCHEMA = f"struct<title:string,body:struct<content:array<{_ELEM}>>>"


def _para_text(p):
    els = F.coalesce(p["elements"], F.array())
    raw = F.array_join(F.transform(els, lambda e: F.concat(
        F.coalesce(e["textRun"]["content"], F.lit("")),
        F.when(e["inlineObjectElement"].isNotNull(), F.lit("[Image]")).otherwise(F.lit("")))), "")
    bullet = F.when(p["bullet"].isNotNull(), F.concat(F.lit("• "), py_strip(raw))).otherwise(raw)
    return F.when(p.isNull(), F.lit("")).otherwise(py_strip(bullet))


def _table_text(t):
    rows = F.transform(F.coalesce(t["tableRows"], F.array()), lambda r: F.array_join(F.transform(
        F.coalesce(r["tableCells"], F.array()), lambda c: F.array_join(F.filter(
            F.transform(F.coalesce(c["content"], F.array()), lambda x: _para_text(x["paragraph"])), lambda s: s != ""), " ")),
        " | "))
    return F.when(t.isNull(), F.lit("")).otherwise(F.array_join(rows, "\n"))


def _elem_text(e, with_toc=True):
    parts = [_para_text(e["paragraph"]), _table_text(e["table"])]
    if with_toc:
        toc = F.transform(F.coalesce(e["tableOfContents"]["content"], F.array()), lambda x: _elem_text(x, False))
        return F.array_join(F.filter(F.concat(F.array(*parts), toc), lambda s: s != ""), "\n")
    return F.array_join(F.filter(F.array(*parts), lambda s: s != ""), "\n")


def document_structure_text(df: DataFrame, json_col: str, out: str = "text", include_title: bool = True,
                            separator: str = "\n\n") -> DataFrame:
    """D-18: document structure JSON -> text: title and a blank part, then each body element
    (paragraph runs with "[Image]" for inline objects, "• " bullets, tables as "a | b" rows,
    table-of-contents entries), non-empty parts joined by ``separator``. Fixed-depth schema,
    nested ``transform``; the bullet indent is stripped with the paragraph, as in the reference."""
    d = df.withColumn("_doc", F.from_json(F.col(json_col), DOC_SCHEMA))
    body = F.filter(F.transform(F.coalesce(F.col("_doc.body.content"), F.array()), lambda e: _elem_text(e)), lambda s: s != "")
    head = F.when(F.lit(include_title) & F.col("_doc.title").isNotNull(), F.array(F.col("_doc.title"), F.lit(""))) \
        .otherwise(F.array().cast("array<string>"))
    return d.withColumn(out, F.array_join(F.concat(head, body), separator)).drop("_doc")
